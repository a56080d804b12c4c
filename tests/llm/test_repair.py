import hashlib
import random
from functools import cache
from zlib import crc32

import pytest

from cliptide.llm import repair, turns

SCHEMA = "conv_id long, turn long, role string, text string, fault string, PART string"
SPACE = " \t\n\x0b\x0c\r"


def best(rows):
    """(cost, letters) over all edit sequences, of rows (initial, must go, truncated)."""
    moves = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    @cache
    def go(i, state, inserted):
        ways = [(0, "")] if i == len(rows) and state in ("", "a") else []
        follow = [(c, moves[state, c]) for c in "sua" if (state, c) in moves]
        add = lambda cost, letter, tail: ways.append((cost + tail[0], letter + tail[1])) if tail else None
        if inserted < 3:
            for c, to in follow:
                if c != "s":
                    add(5, "I", go(i, to, inserted + 1))
        if i < len(rows):
            initial, goes, cut = rows[i]
            add(2, "D", go(i + 1, state, 0))
            for c, to in follow:
                if not goes and c == initial:
                    add(5 * cut, "K", go(i + 1, to, 0))
                if not goes and c != "s":
                    add(1 + 5 * cut, "R", go(i + 1, to, 0))
        return min(ways) if ways else None

    return go(0, "", 0)


def damaged(rows):
    for conv, turn, role, text, *_ in rows:
        role, text = " " if role is None else role, " " if text is None else text
        kind = crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * {0: 0, 3: 2}.get(kind, 1)


def plain(rows):
    """{conv_id: (gaps, blank, duplicate, truncated, illegal, cost, audit, sha)} of rows as they are."""
    convs, result = {}, {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn, " " if role is None else role, " " if text is None else text))
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        known = sorted({t for t, *_ in some if t is not None})
        counts, seen, symbols = {"blank": 0, "duplicate": 0, "truncated": 0, "": 0}, set(), []
        for _, role, text in some:
            body = text.rstrip(SPACE)
            fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else ""
            seen.add((role, text))
            counts[fault] += 1
            symbols.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        pairs = [a[1][:1] + b[1][:1] for a, b in zip(some, some[1:])]
        cost, audit = best(tuple(symbols))
        left, at = [], 0
        n = sum(x != "D" for x in audit)
        for letter in audit:
            row = some[at] if letter != "I" else None
            at += letter != "I"
            if letter != "D":
                role = row[1] if letter == "K" else ("assistant", "user")[(len(left) + 1 - n % 2) % 2]
                left.append(f"{role}:{row[2] if row else ''}")
        result[conv] = (
            known[-1] - known[0] + 1 - len(known) if known else 0, counts["blank"], counts["duplicate"], counts["truncated"],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest(),
        )
    return result


def got(df):
    return {r.conv_id: tuple(r)[1:] for r in repair.summary(repair.find_repairs(df)).collect()}


def made():
    rng = random.Random(5)
    texts = ["One.", "Two!", "three", "", " \t", None, "Four?  \n", "five  ", "Six.", "Seven."]
    rows = []
    for conv in range(80):
        for turn in range(rng.randrange(1, 10)):
            role = rng.choice(["user", "assistant", "system", "tool", "", None]) if conv % 2 else ("user", "assistant")[turn % 2]
            text = f"{rng.random()}." if rng.random() < 0.7 else rng.choice(texts)
            rows.append((conv, rng.choice([turn, turn, 3 * turn, None]), role, text, "x", "y"))
    rows += [(None, None, "user", "no id.", "", ""), (90, 0, "user", "long " * 300_000, "", ""), (91, 4, "user", "a.", "", ""), (91, 4, "user", "a.", "", "")]
    return rows + [(99, t, rng.choice(["user", "assistant", "user", "system"]), f"{t}{rng.choice('..x')}" if t % 50 else "Again.", "", "") for t in range(180)]


@pytest.mark.parametrize("rows_at_once", [5, 4096])
def test_same_as_plain(spark, monkeypatch, rows_at_once):
    monkeypatch.setattr(turns, "ROWS", rows_at_once)
    rows = made()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(4)) == plain(rows)


def test_damage(spark):
    rows = made()[:500]
    out = repair.damage(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(repr, map(tuple, out))) == sorted(map(repr, damaged(rows)))


def test_block_sizes_agree():
    rng = random.Random(8)
    tables = [repair.Tables(b) for b in (1, 2, 3, 4)]
    for _ in range(200):
        symbols = bytes(rng.choices(range(9), k=rng.randrange(30)))
        rows = [("sua "[(s - 1) // 2] if s else "u", s == 0, s > 0 and (s - 1) % 2) for s in symbols]
        want = best(tuple(rows))
        for table in tables:
            borders, cost = table.back(table.blocks(symbols), table.number[repair.END])
            assert (cost + table.vectors[borders[0]][repair.START], table.trace(symbols, repair.END, repair.START, True)[0]) == want


def test_long_conversation_in_pieces(spark):
    """One conversation of 30,000 rows and its pieces give what one table run over all of it gives."""
    rows = [(1, t, ("user", "assistant", "user", "system")[t * 7 % 4 if t % 3 else t % 2], f"{t}.") for t in range(30_000)]
    found = repair.find_repairs(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert found.count() > 5
    symbols = bytes(1 + 2 * "sua".index(r[2][0]) for r in rows)
    table = repair.tables()
    borders, cost = table.back(table.blocks(symbols), table.number[repair.END])
    row = repair.summary(found).first()
    assert (row.cost, row.audit) == (cost + table.vectors[borders[0]][0], table.trace(symbols, repair.END, 0, True)[0])


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
