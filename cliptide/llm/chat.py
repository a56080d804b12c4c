"""Conversations as training text, by a declarative template.

A template names the control strings around the texts of each role, which texts count for the loss, and
which role may follow which. A finite-state machine over the roles (a state is the role last seen) marks
the first turn out of order; every turn is still formatted. The output is a list of text segments, each
with a loss flag; written one after another they are the training text, and ``read`` finds the turns in
it again.

Inside texts and unknown roles a control string gets a backslash after its first character, and one more
if it has some already, so that no control string is left and the way back is unique.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm.turns import along, before, beside, pieces


@dataclass(frozen=True)
class Turn:
    """The control strings around a text, and whether the text counts for the loss."""

    opens: str
    closes: str
    loss: bool = False


def _turns() -> dict[str, Turn]:
    return {"system": Turn("[SYS] ", " [/SYS]"), "user": Turn("[INST] ", " [/INST]"), "assistant": Turn("<s> ", " </s>", loss=True)}


def _follows() -> dict[str | None, tuple[str, ...]]:
    return {None: ("system", "user"), "system": ("user",), "user": ("assistant",), "assistant": ("user",)}


@dataclass(frozen=True)
class Template:
    """``follows`` maps the last role (None at the start) to those that may come next; a conversation
    may end with a role of ``ends``. A turn of any other role is ``other``, which names the role."""

    turns: dict[str, Turn] = field(default_factory=_turns)
    other: tuple[str, str, str] = ("[ROLE] ", " [/ROLE] ", " [/TURN]")
    follows: dict[str | None, tuple[str, ...]] = field(default_factory=_follows)
    ends: tuple[str, ...] = ("assistant",)

    def __post_init__(self):
        for control in self.controls:
            unclear = any(other[:1] in control[1:] or (other != control and other.startswith(control)) for other in self.controls)
            if unclear or not re.fullmatch(r"[^\w\s\\][^\s\\]+", control):
                raise ValueError(f"{control!r} cannot be escaped: it needs a first mark that no control string holds further on")

    @property
    def controls(self) -> list[str]:
        strings = [s for t in self.turns.values() for s in (t.opens, t.closes)] + list(self.other)
        return sorted({s.strip() for s in strings})

    @property
    def pattern(self) -> str:
        """Control strings with any number of backslashes after the first character."""
        quoted = lambda s: "".join(f"\\{c}" if not c.isalnum() else c for c in s)
        return "|".join(f"(?<={quoted(c[0])})(?=\\\\*{quoted(c[1:])})" for c in self.controls)

    def code(self, role: Column) -> Column:
        """Number of a role in the template, from 1; 0 for any other."""
        return F.coalesce(F.array_position(F.lit(list(self.turns)), role), F.lit(0))

    def legal(self, last: Column, role: Column) -> Column:
        """Whether the role coded ``role`` may follow the one coded ``last`` (null at the start)."""
        number = {name: i + 1 for i, name in enumerate(self.turns)}
        pairs = [number[b] + 1000 * (0 if a is None else number[a]) for a, to in self.follows.items() for b in to]
        # 0 as the last role is the start in these pairs, so that other roles need a number of their own.
        state = F.when(last.isNull(), 0).when(last == 0, 999).otherwise(last)
        return (state * 1000 + role).isin(pairs)

    def escape(self, text: Column) -> Column:
        return F.regexp_replace(text, self.pattern, "\\\\")

    def segments(self, role: Column, text: Column) -> Column:
        """The segments of one turn; empty ones are left out."""
        part = lambda value, loss=False: F.struct(value.alias("text"), F.lit(loss).alias("loss"))
        body = self.escape(text)
        start, middle, end = self.other
        made = F.array(part(F.concat(F.lit(start), self.escape(role), F.lit(middle))), part(body), part(F.lit(end)))
        for name, turn in self.turns.items():
            own = F.array(part(F.lit(turn.opens)), part(body, turn.loss), part(F.lit(turn.closes)))
            made = F.when(role == name, own).otherwise(made)
        return F.filter(made, lambda s: s["text"] != "")

    def reader(self):
        """A function from formatted text to (role, text, start, end) of each turn; offsets are those of
        the escaped text."""
        named = {f"r{i}": name for i, name in enumerate(self.turns)}
        ways = [f"{re.escape(self.turns[name].opens)}(?P<{key}>.*?){re.escape(self.turns[name].closes)}" for key, name in named.items()]
        start, middle, end = map(re.escape, self.other)
        turn = re.compile("|".join([*ways, f"{start}(?P<role>.*?){middle}(?P<other>.*?){end}"]), re.S)
        plain = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\(?=\\\\*{re.escape(c[1:])})" for c in self.controls))
        bare = lambda text: plain.sub("", text)

        def read(text: str):
            at = 0
            while at < len(text):
                found = turn.match(text, at)
                if found is None:
                    raise ValueError(f"no turn of the template begins at {at}: {text[at : at + 40]!r}")
                key = found.lastgroup
                role = bare(found["role"]) if key == "other" else named[key]
                yield role, bare(found[key]), *found.span(key)
                at = found.end()

        return read, bare


def format_turns(turns: DataFrame, template: Template = Template(), conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, part, seq, whole, segments, n_turns, fault, last): the conversations in pieces.

    ``segments`` is a list of (text, loss). ``n_turns`` counts the turns of a piece, ``fault`` is the place
    (from 0, in the conversation) of the first turn of the piece that is out of order, or null, and
    ``last`` the code of the piece's last role.

    A null text is empty, a null role is the role of no name, a null conversation id is a conversation of
    its own. Turns are in the order of ``turn`` (nulls first), then role and text; repeated rows are
    repeated turns. An empty table gives no rows. Other columns are ignored, whatever their names. A
    conversation of any length is spread over tasks.
    """
    rows = turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"),
    )
    cut = pieces(rows, "conv_id", ["turn", "role"], ["text"], ["role", "text"])
    thin = cut.filter("NOT whole").select("conv_id", "part", "seq", F.size("rows").alias("n"), template.code(F.element_at("rows", -1)["role"]).alias("code"))
    carried = before(thin, "conv_id", entry=F.last("code"), base=F.sum("n"))
    none = F.lit(None)
    placed = cut.filter("whole").withColumns({"entry": none.cast("long"), "base": none.cast("long")}).unionByName(beside(cut.filter("NOT whole"), carried))
    coded = placed.withColumn("codes", F.transform("rows", lambda r: template.code(r["role"])))
    wrong = F.transform("codes", lambda c, i: ~template.legal(F.when(i == 0, F.col("entry")).otherwise(F.get("codes", i - 1)), c))
    return coded.select(
        "conv_id", "part", "seq", "whole",
        F.flatten(F.transform("rows", lambda r: template.segments(r["role"], r["text"]))).alias("segments"),
        F.size("rows").cast("long").alias("n_turns"),
        (F.nullif(F.array_position(wrong, True), F.lit(0)) - 1 + F.coalesce("base", F.lit(0))).alias("fault"),
        F.element_at("codes", -1).alias("last"),
    )


def read(formatted: DataFrame, template: Template = Template()) -> DataFrame:
    """(conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, fault, complete).

    The turns are parsed from the segments' text; what counts for the loss is taken from their flags.
    Hashes are of role, line feed, text, line feed per turn, and of the texts under the loss, all
    unescaped. ``fault`` is the first turn out of order, ``complete`` whether there is none and the
    last role may end a conversation. A hash has to follow its conversation from start to end, so a
    conversation of several pieces is one task's stream; its memory does not grow with it.
    """
    import hashlib

    parse, bare = template.reader()
    ends = {i + 1 for i, name in enumerate(template.turns) if name in template.ends}

    def step(conv, rows):
        every, loss = hashlib.sha256(), hashlib.sha256()
        n = loss_chars = chars = 0
        fault = last = None
        for row in rows:
            body = "".join(s["text"] for s in row["segments"])
            chars += len(body)
            for role, text, *_ in parse(body):
                every.update(f"{role}\n{text}\n".encode())
                n += 1
            for segment in row["segments"]:
                if segment["loss"]:
                    text = bare(segment["text"])
                    loss.update(text.encode())
                    loss_chars += len(text)
            fault = row["fault"] if fault is None else fault
            last = row["last"]
        return {
            "conv_id": conv, "n_turns": n, "turns_sha256": every.hexdigest(), "loss_chars": loss_chars, "loss_sha256": loss.hexdigest(),
            "formatted_chars": chars, "fault": fault, "complete": fault is None and last in ends,
        }

    kind = formatted.schema["conv_id"].dataType.simpleString()
    fields = "n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, fault long, complete boolean"
    return along(formatted.select("conv_id", "part", "seq", "whole", "segments", "fault", "last"), "conv_id", step, f"conv_id {kind}, {fields}")
