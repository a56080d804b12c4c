"""Cheapest repair of the turn structure of conversations, by Four-Russians block tables.

A row is kept, given another role, or deleted, and rows may be inserted, so that the roles' initials read
``(s?(ua)+)?``. With one cost to go for each of the grammar's four states, a row maps a vector of four costs
to another. Up to an added constant only a few dozen vectors occur, so the maps of all blocks of ``BLOCK``
symbols are tabulated once: (vector, block) -> (vector, constant). A conversation is taken from its end to
its start by block lookups; then each block is expanded to single rows between the vectors at its borders,
from the first to the last, the least letter first among the edits that keep the total. So of all
cheapest repairs the one whose letters (D, I, K, R) are least as text is found.

Conversations that spread over several pieces: a piece is a 4 x 4 matrix of costs (from state to state),
the matrices are chained from the end for the costs behind every piece, then the states between the pieces
from the start; only these thin rows, one for each piece of up to 4,096 rows, are brought together.
"""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import ASCII_SPACE
from cliptide.llm.turns import along, pieces
from cliptide.operators.exact import settled

DELETE, REROLE, INSERT, TRUNCATED = 2, 1, 5, 5
#: Symbols in a block.
BLOCK = 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: (state, initial) -> state
MOVES = {(START, "s"): SYSTEM, (START, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (START, ASSISTANT)
FAR = 1 << 20
INITIALS = "sua"
#: A symbol is 0 (must go), 1 + 2 * place of the initial (3: none of the grammar's) + truncated, or NOTHING.
NOTHING = 9
SYMBOLS = 10


def _inserted(costs: list[int]) -> list[int]:
    """Costs when rows may be inserted first."""
    for _ in range(3):
        costs = [min([c, *[INSERT + costs[MOVES[s, i]] for i in "ua" if (s, i) in MOVES]]) for s, c in enumerate(costs)]
    return [min(c, FAR) for c in costs]


def _edits(symbol: int, state: int):
    """(letter, cost, next state) of what may be done with a row."""
    if symbol == NOTHING:
        return [("", 0, state)]
    edits = [("D", DELETE, state)]
    if symbol:
        place, cut = divmod(symbol - 1, 2)
        if place < 3 and (state, INITIALS[place]) in MOVES:
            edits.append(("K", TRUNCATED * cut, MOVES[state, INITIALS[place]]))
        edits += [("R", REROLE + TRUNCATED * cut, MOVES[state, i]) for i in "ua" if (state, i) in MOVES]
    return edits


def _row(symbol: int, behind: tuple[int, ...]) -> list[int]:
    """Costs to go before a row from those behind it."""
    return _inserted([min(cost + behind[to] for _, cost, to in _edits(symbol, s)) for s in range(4)])


def _normal(costs: list[int]) -> tuple[tuple[int, ...], int]:
    least = min(costs)
    return tuple(min(c - least, FAR) if c < FAR // 2 else FAR for c in costs), least


END = tuple(_inserted([0 if s in ENDS else FAR for s in range(4)]))
#: Behind a piece whose last state has to be ``j``.
UNITS = [tuple(_inserted([0 if s == j else FAR for s in range(4)])) for j in range(4)]


class Tables:
    """All vectors that occur, and for every block of symbols where it takes each of them."""

    def __init__(self, block: int = BLOCK):
        import numpy as np

        self.block = block
        self.vectors = list(dict.fromkeys([END, *UNITS]))
        self.number = {v: i for i, v in enumerate(self.vectors)}
        rows: list[list[tuple[int, int]]] = []
        for vector in self.vectors:  # grows on the way
            found = []
            for symbol in range(SYMBOLS):
                after, add = _normal(_row(symbol, vector))
                if after not in self.number:
                    self.number[after] = len(self.vectors)
                    self.vectors.append(after)
                found.append((self.number[after], add))
            rows.append(found)
        to, add = (np.array([[x[i] for x in found] for found in rows], np.int32) for i in range(2))
        # Blocks are numbered by their symbols, the first one first; the last symbol is applied first.
        self.to, self.add = to, add
        for _ in range(block - 1):
            onward, plus = self.to, self.add
            self.to = to[onward[:, None, :], np.arange(SYMBOLS)[None, :, None]].reshape(len(to), -1)
            self.add = (add[onward[:, None, :], np.arange(SYMBOLS)[None, :, None]] + plus[:, None, :]).reshape(len(to), -1)
        self.expanded: dict[tuple[int, int, int], tuple[str, int]] = {}

    def blocks(self, symbols: bytes) -> list[int]:
        """Numbers of the blocks; the last one is filled up with NOTHING."""
        import numpy as np

        cells = np.full(-(-len(symbols) // self.block) * self.block, NOTHING, np.int64)
        cells[: len(symbols)] = np.frombuffer(symbols, np.uint8)
        return (cells.reshape(-1, self.block) @ (SYMBOLS ** np.arange(self.block)[::-1])).tolist()

    def back(self, blocks: list[int], behind: int) -> tuple[list[int], int]:
        """Vectors at the borders of the blocks (the first one's start first), and the constant of the start."""
        borders, total = [behind], 0
        for block in reversed(blocks):
            total += int(self.add[behind, block])
            behind = int(self.to[behind, block])
            borders.append(behind)
        return borders[::-1], total

    def expand(self, block: int, behind: int, state: int) -> tuple[str, int]:
        """The least letters among the cheapest edits of a block entered in ``state``, and its last state."""
        key = (block, behind, state)
        if key not in self.expanded:
            symbols = [block // SYMBOLS**i % SYMBOLS for i in range(self.block)][::-1]
            costs = [list(self.vectors[behind])]
            for symbol in reversed(symbols):
                costs.append(_row(symbol, costs[-1]))
            costs.reverse()
            letters = ""
            for i, symbol in enumerate(symbols):
                moved = False
                while not moved:
                    ways = [(x, to, True) for x, cost, to in _edits(symbol, state) if cost + costs[i + 1][to] == costs[i][state]]
                    ways += [("I", MOVES[state, r], False) for r in "ua" if (state, r) in MOVES and symbol != NOTHING and INSERT + costs[i][MOVES[state, r]] == costs[i][state]]
                    letter, state, moved = min(ways)
                    letters += letter
            self.expanded[key] = letters, state
        return self.expanded[key]

    def trace(self, symbols: bytes, behind: tuple[int, ...], state: int, last: bool) -> tuple[str, int]:
        """Letters and the last state of one piece; after the last piece missing rows are inserted."""
        blocks = self.blocks(symbols)
        borders, _ = self.back(blocks, self.number[behind])
        letters = []
        for block, border in zip(blocks, borders[1:]):
            some, state = self.expand(block, border, state)
            letters.append(some)
        while last and state not in ENDS:
            state = MOVES[state, "u" if (state, "u") in MOVES else "a"]
            letters.append("I")
        return "".join(letters), state

    def matrix(self, symbols: bytes) -> list[int]:
        """Cost from each state (rows) to each state (columns) over one piece."""
        blocks = self.blocks(symbols)
        columns = []
        for unit in UNITS:
            borders, total = self.back(blocks, self.number[unit])
            columns.append([min(c + total, FAR) for c in self.vectors[borders[0]]])
        return [columns[j][s] for s in range(4) for j in range(4)]


@cache
def tables() -> Tables:
    return Tables()


def behind_pieces(matrices: list[list[int]]) -> list[tuple[int, ...]]:
    """The normal vector behind each piece, from the matrices of all pieces of one conversation."""
    vectors = [END]
    for matrix in reversed(matrices[1:]):
        costs = [min(matrix[4 * s + j] + vectors[-1][j] for j in range(4)) for s in range(4)]
        vectors.append(_normal([min(c, FAR) for c in costs])[0])
    return vectors[::-1]


def _chained(pdf_key: str, make):
    """applyInPandas over the thin rows of one conversation, in order."""

    def run(pdf):
        import pandas as pd

        pdf = pdf.sort_values(["part", "seq"])
        return pd.DataFrame({"part": pdf.part, "seq": pdf.seq, "made": make(pdf[pdf_key].tolist())})

    return run


def _entries(exits: list) -> list[int]:
    states, state = [], START
    for row in exits:
        states.append(state)
        state = int(row[state])
    return states


def _mapped(df: DataFrame, make, out: str, kind: str) -> DataFrame:
    """(conv_id, part, seq, out): ``make(row)`` over thin rows."""
    from pyspark.sql import types as T

    schema = T.StructType([df.schema["conv_id"], df.schema["part"], df.schema["seq"], *T.StructType.fromDDL(f"{out} {kind}").fields])

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for batch in batches:
            made = pa.array([make(row) for row in batch.to_pylist()], to_arrow_type(schema[out].dataType))
            yield pa.RecordBatch.from_arrays([batch.column("conv_id"), batch.column("part"), batch.column("seq"), made], schema.names)

    return df.mapInArrow(run, schema)


def _trimmed(text: Column) -> Column:
    return F.rtrim(text, F.lit(ASCII_SPACE))


def find_repairs(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, seq, whole, rows, letters, entry): the pieces of all conversations with their repair.

    ``rows`` holds (turn, role, text, fault, again) in the order of ``turn`` (nulls first), role and
    text. ``fault`` is blank, duplicate, truncated or null; a row that ``again`` repeats the one before
    is a duplicate too. ``letters`` are the edits in order: D, I (a row before the next one; after the
    last row in the last piece), K and R; ``entry`` is the grammar's state before the piece.

    Null texts and roles count as one space, a null conversation id is a conversation of its own.
    An empty table gives no rows; other columns are ignored, whatever their names.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"), F.coalesce(F.col(text), F.lit(" ")).alias("text"),
    ).withColumn("_digest", F.when(_trimmed(F.col("text")) != "", F.unhex(F.sha2("text", 256))))
    # Texts that come back at a later turn: combined map-side, and only those that do come back are kept.
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    firsts = rows.filter("_digest IS NOT NULL").groupBy(F.struct("conv_id").alias("_conv"), F.col("role").alias("_role"), F.col("_digest").alias("_same")).agg(
        F.min(place).alias("_first"), F.max(place).alias("_last")
    )
    again = firsts.filter("_first < _last").drop("_last")
    joined = rows.join(again, (F.struct("conv_id") == F.col("_conv")) & (F.col("role") == F.col("_role")) & (F.col("_digest") == F.col("_same")), "left")
    ends = F.substring(_trimmed(F.col("text")), -1, 1)
    fault = (
        F.when(F.col("_digest").isNull(), "blank").when(F.col("_first") < place, "duplicate").when(~ends.isin(".", "!", "?"), "truncated")
    )
    judged = joined.select("conv_id", "turn", "role", "text", fault.alias("fault"))
    cut = pieces(judged, "conv_id", ["turn", "role"], ["text"], ["turn", "role", "text", "fault"])

    goes = lambda r: F.coalesce(r["fault"].isin("blank", "duplicate"), F.lit(False)) | r["again"]
    initial = lambda r: F.coalesce(F.nullif(F.array_position(F.lit(list(INITIALS)), F.substring(r["role"], 1, 1)), F.lit(0)) - 1, F.lit(3))
    symbol = lambda r: F.when(goes(r), 0).otherwise(1 + 2 * initial(r) + F.when(r["fault"] == "truncated", 1).otherwise(0))
    coded = cut.withColumn("symbols", F.array_join(F.transform("rows", lambda r: symbol(r).cast("string")), ""))
    plain = lambda row: bytes(map(int, row["symbols"]))

    whole = coded.filter("whole").select("conv_id", "part", "seq", "symbols")
    straight = _mapped(whole, lambda row: {"letters": tables().trace(plain(row), END, START, True)[0], "entry": START}, "repair", "struct<letters: string, entry: int>")

    edges = coded.filter("NOT whole").select("conv_id", "part", "seq", "symbols")
    matrices = _mapped(edges, lambda row: tables().matrix(plain(row)), "matrix", "array<int>")
    behind = matrices.groupBy("conv_id").applyInPandas(_chained("matrix", behind_pieces), "part int, seq int, made array<int>")
    vectored = settled(edges.join(behind.withColumnRenamed("made", "behind"), ["part", "seq"]), "behind")
    exits = _mapped(vectored, lambda row: [tables().trace(plain(row), tuple(row["behind"]), s, False)[1] if row["behind"][s] < FAR and _open(row, s) else s for s in range(4)], "exits", "array<int>")
    entries = exits.groupBy("conv_id").applyInPandas(_chained("exits", _entries), "part int, seq int, made int")
    ending = edges.groupBy("conv_id").agg(F.max(F.struct("part", "seq")).alias("tail")).select(F.col("tail.part").alias("part"), F.col("tail.seq").alias("seq"), F.lit(True).alias("tail"))
    ready = vectored.join(entries.withColumnRenamed("made", "entry"), ["part", "seq"]).join(ending, ["part", "seq"], "left")
    traced = _mapped(
        ready, lambda row: {"letters": tables().trace(plain(row), tuple(row["behind"]), row["entry"], bool(row["tail"]))[0], "entry": row["entry"]}, "repair", "struct<letters: string, entry: int>"
    )
    found = straight.unionByName(traced).select("part", "seq", "repair.*")
    return cut.join(found, ["part", "seq"]).select("conv_id", "part", "seq", "whole", "rows", "letters", "entry")


def _open(row, state: int) -> bool:
    """Whether the grammar can go on from ``state`` over the piece and what follows it."""
    table = tables()
    blocks = table.blocks(bytes(map(int, row["symbols"])))
    borders, _ = table.back(blocks, table.number[tuple(row["behind"])])
    return table.vectors[borders[0]][state] < FAR


def repaired(rows, letters: str, state: int):
    """(role, text) of what the edits leave of one piece, and the state after it."""
    left, at = [], 0
    for letter in letters:
        row = None
        if letter != "I":
            row, at = rows[at], at + 1
            if letter == "D":
                continue
        if letter == "K":
            role, initial = row["role"], row["role"][:1]
        else:
            initial = "a" if state == USER else "u"
            role = "assistant" if state == USER else "user"
        state = MOVES[state, initial]
        left.append((role, "" if row is None else row["text"]))
    return left, state


def summary(repairs: DataFrame) -> DataFrame:
    """One row for each conversation of ``find_repairs``: conv_id, gaps, blank, duplicate, truncated, illegal
    (neighbouring rows whose initials are not su, ua or au), cost, audit (all letters), repaired_sha256.

    The hash and the audit follow a conversation from start to end, so one of several pieces is one
    task's stream.
    """
    import hashlib

    price = {"D": DELETE, "K": 0, "R": REROLE}

    def step(conv, flow):
        digest, audit = hashlib.sha256(), []
        counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        illegal = cost = distinct = 0
        state, before, low, high, some = START, None, None, None, False
        for piece in flow:
            rows = piece["rows"]
            for row in rows:
                fault = "duplicate" if row["again"] and row["fault"] != "blank" else row["fault"]
                row["fault"] = fault
                if fault:
                    counts[fault] += 1
                initial = row["role"][:1]
                illegal += before is not None and before + initial not in ("su", "ua", "au")
                before = initial
                if row["turn"] is not None and row["turn"] != high:
                    distinct, low, high = distinct + 1, row["turn"] if low is None else low, row["turn"]
            at = 0
            for letter in piece["letters"]:
                if letter == "I":
                    cost += INSERT
                else:
                    cost += price[letter] + TRUNCATED * (letter != "D" and rows[at]["fault"] == "truncated")
                    at += 1
            left, state = repaired(rows, piece["letters"], state)
            for role, text in left:
                digest.update(("\n" * some + f"{role}:{text}").encode())
                some = True
            audit.append(piece["letters"])
        return {
            "conv_id": conv, "gaps": 0 if high is None else high - low + 1 - distinct, **counts, "illegal": illegal, "cost": cost,
            "audit": "".join(audit), "repaired_sha256": digest.hexdigest(),
        }

    kind = repairs.schema["conv_id"].dataType.simpleString()
    fields = "gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
    return along(repairs.select("conv_id", "part", "seq", "whole", "rows", "letters"), "conv_id", step, f"conv_id {kind}, {fields}")


def damage(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Damaged rows for tests of the repair, by crc32 of ``conv_id:turn`` modulo 20: 0 drops a row, 1 empties
    its text, 2 takes its ``.!?`` away, 3 repeats it, 4 makes its role user. Nulls count as one space."""
    plain = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(plain(conv_id), F.lit(":"), plain(turn)).cast("binary")) % 20
    words = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(plain(text), "[.!?]", "")).otherwise(plain(text))
    damaged = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.when(kind == 4, "user").otherwise(plain(role)).alias("role"),
        words.alias("text"), F.explode(F.array_repeat(F.lit(0), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("int"))),
    )
    return damaged.drop("col")
