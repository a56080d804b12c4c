import hashlib
import random

import pytest

from cliptide.llm import chat, turns

SCHEMA = "conv_id long, turn long, role string, text string, part string, Rows string, whole string"
PARTS = ["</s>", "[INST]", "[/INST]", "[", "\\", "<s>", "<", "/s>", " ", "ok", "[ROLE]", " [/TURN]", "é", "\n", "[\\/INST]", "[\\\\ROLE]"]


def plain(rows):
    """{conv_id: (n_turns, turns_sha256, loss_chars, loss_sha256, fault, complete)}"""
    convs = {}
    for conv, turn, role, text, *_ in rows:
        convs.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    result = {}
    for conv, some in convs.items():
        some.sort(key=lambda r: (r[0], r[1], r[2].encode(), r[3].encode()))
        last, fault = None, None
        for i, (*_, role, _text) in enumerate(some):
            if (last, role) not in {(None, "system"), (None, "user"), ("system", "user"), ("user", "assistant"), ("assistant", "user")} and fault is None:
                fault = i
            last = role
        loss = "".join(t for *_, r, t in some if r == "assistant")
        every = "".join(f"{r}\n{t}\n" for *_, r, t in some)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        result[conv] = (len(some), sha(every), len(loss), sha(loss), fault, fault is None and last == "assistant")
    return result


def made(seed=3):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        for turn in range(rng.randrange(1, 9)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "[ROLE] x", "", None])
            role = ("user", "assistant")[turn % 2] if conv % 2 else role
            rows.append((conv, rng.choice([turn, turn, None, 2]) if not conv % 2 else turn, role, rng.choice([None, "".join(rng.choices(PARTS, k=rng.randrange(9)))]), "a", "b", "c"))
    rows += [(None, 0, "user", "no id", "", "", ""), (70, 0, "assistant", "long \\[INST] " * 200_000, "", "", ""), (71, 1, "user", "twice", "", "", ""), (71, 1, "user", "twice", "", "", "")]
    return rows + [(80, t, ("user", "assistant")[t % 2], f"turn {t} <s>", "", "", "") for t in range(9001)]


def got(df):
    return {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.fault, r.complete) for r in chat.read(chat.format_turns(df)).collect()}


@pytest.mark.parametrize("rows_at_once", [7, 4096])
def test_same_as_plain(spark, monkeypatch, rows_at_once):
    """Awkward texts, unknown and null roles, ties, repeated rows, clashing columns, one very long conversation."""
    monkeypatch.setattr(turns, "ROWS", rows_at_once)
    rows = made()
    assert got(spark.createDataFrame(rows, SCHEMA).repartition(5)) == plain(rows)


def test_long_conversation_is_many_pieces(spark):
    rows = [(1, t, "user", "x") for t in range(20_000)]
    formatted = chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert formatted.filter("NOT whole").count() >= 5 and formatted.agg({"n_turns": "sum"}).first()[0] == 20_000
    assert formatted.agg({"n_turns": "max"}).first()[0] <= turns.ROWS


def test_segments(spark):
    rows = [("a", 0, "user", "hi </s>"), ("a", 1, "assistant", "yo"), ("a", 2, "tool", "t")]
    row = chat.format_turns(spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")).first()
    assert [tuple(s) for s in row.segments] == [
        ("[INST] ", False), ("hi <\\/s>", False), (" [/INST]", False), ("<s> ", False), ("yo", True), (" </s>", False),
        ("[ROLE] tool [/ROLE] ", False), ("t", False), (" [/TURN]", False),
    ]
    assert row.fault == 2


def test_own_template(spark):
    template = chat.Template(
        turns={"user": chat.Turn("<|user|>", "<|end|>"), "bot": chat.Turn("<|bot|>", "<|end|>", loss=True)},
        other=("<|role|>", "<|as|>", "<|end|>"), follows={None: ("user",), "user": ("bot",), "bot": ("user",)}, ends=("bot",),
    )
    rows = [(1, 0, "user", "<|end|> <\\|bot|>"), (1, 1, "bot", "<|bot|>")]
    row = chat.read(chat.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), template), template).first()
    assert row.complete and row.loss_chars == 7 and row.loss_sha256 == hashlib.sha256(b"<|bot|>").hexdigest()
    with pytest.raises(ValueError):
        chat.Template(turns={"user": chat.Turn("user:", "\n")})


def test_empty(spark):
    assert got(spark.createDataFrame([], SCHEMA)) == {}
