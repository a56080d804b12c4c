import random

import numpy as np
import plain
import pytest
from sentencepiece import SentencePieceProcessor

from cliptide.llm import pieces
from cliptide.llm.queries import PIECE_MODEL

TEXTS = [
    "Hello world", "  two  spaces ", "a\nb\tc", "né 日本 🎉\u0000", "", "x" * 700, "▁mark▁ed", "the of, the in thereof", " ", "ﬁ ͏ \U0010ffff",
]


@pytest.fixture(scope="module")
def model():
    return pieces.load(PIECE_MODEL)


@pytest.fixture(scope="module")
def reader():
    return SentencePieceProcessor(model_file=PIECE_MODEL)


def made(n=120):
    rng = random.Random(4)
    return TEXTS + ["".join(rng.choice("abthein é日\n\t🎉 ▁zq") for _ in range(rng.randint(1, 50))) for _ in range(n)]


def encoded(model, texts):
    ids, bounds = pieces.Encoder(model).encode([t.encode() for t in texts])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_scores_are_the_best_there_are(model, reader):
    scores = {p.decode(): float(s) for p, s, i in zip(model.pieces, model.scores, range(len(model.pieces))) if model.spelled[i] and not reader.is_byte(i)}
    for text, ids in zip(made(), encoded(model, made())):
        marked = pieces.marked(text.encode()).decode()
        # A run of byte pieces spells characters that each cost the unknown score.
        total, run = 0.0, b""
        for i in [*ids, None]:
            if i is not None and reader.is_byte(i):
                run += model.spelled[i]
                continue
            total += model.unknown_score * len(run.decode())
            run = b""
            total += float(model.scores[i]) if i is not None else 0
        assert total == pytest.approx(plain.best_pieces(scores, None, model.unknown_score, marked))


def test_lockstep_and_single_agree(model):
    for text, ids in zip(made(), encoded(model, made())):
        assert pieces.segment(model, pieces.marked(text.encode())) == ids


def test_decodes_as_the_library_does(model, reader):
    texts = made()
    ids, bounds = pieces.Encoder(model).encode([t.encode() for t in texts])
    spelled = pieces.spell(model, ids, bounds)
    assert spelled == [t.replace("▁", " ") for t in texts]
    assert spelled == [reader.decode(ids[a:b].tolist()) for a, b in zip(bounds[:-1], bounds[1:])]


def test_words_are_forgotten_without_effect(model, monkeypatch):
    texts = made()
    whole = encoded(model, texts)
    monkeypatch.setattr(pieces, "SEEN_WORDS", 5)
    encoder = pieces.Encoder(model)
    found = [encoder.encode([t.encode()])[0].tolist() for t in texts]
    assert found == whole


def test_trie_holds_its_entries_only():
    entries = [(b"a", 1), (b"ab", 2), (b"b\xff", 3), (b"abc", 4)]
    trie = pieces.DoubleArray(entries)

    def find(key):
        state = 0
        for c in key:
            nxt = int(trie.base[state]) + c
            if trie.check[nxt] != state:
                return -1
            state = nxt
        return int(trie.value[state])

    assert {k: find(k) for k, _ in entries} == dict(entries)
    assert [find(k) for k in (b"", b"b", b"ac", b"abcd", b"\x00")] == [-1] * 5


def test_tables(spark, model, reader):
    rows = [(i, t, "own") for i, t in enumerate(TEXTS)] + [(90, None, None), (90, "again", ""), (90, "again", ""), (91, "word " * 40_000 + "y" * 5000, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string, pieces string")
    found = pieces.encode(df, model)
    assert found.columns == ["doc_id", "text", "pieces", "pieces_"]
    back = pieces.decode(found.select("text", "pieces_.ids", "pieces_.n_bytes"), model).collect()
    assert len(back) == len(rows)
    for r in back:
        assert r.decoded.text == (r.text or "").replace("▁", " ")
        assert r.n_bytes == sum(reader.is_byte(i) for i in r.ids)
    assert pieces.encode(df.limit(0), model).count() == 0


def test_null_lists_and_control_pieces_spell_nothing(spark, model):
    df = spark.createDataFrame([(1, None), (2, []), (3, [1, 2])], "n int, ids array<int>")
    assert {r.n: r.decoded.text for r in pieces.decode(df, model).collect()} == {1: "", 2: "", 3: ""}


def test_gathered_runs():
    flat, bounds = pieces.gathered(np.array([5, 6, 7, 8]), np.array([0, 2, 2, 4]), np.array([2, 1, 0]))
    assert flat.tolist() == [7, 8, 5, 6] and bounds.tolist() == [0, 2, 2, 4]


def test_texts_and_pieces_are_taken_in_small_slices(spark, model, monkeypatch):
    """A word and a piece take many times their bytes while a slice is worked on."""
    limits, real = [], pieces.append_struct

    def kept(docs, column, out, fields, make, read=None, limit=None):
        limits.append(limit or 4 << 20)
        return real(docs, column, out, fields, make, *([read] if read else []), limit=limit)

    monkeypatch.setattr(pieces, "append_struct", kept)
    docs = spark.createDataFrame([(i, "some words here " * 40_000) for i in range(3)], "doc_id long, text string").coalesce(1)
    read = pieces.decode(pieces.encode(docs, model).select("doc_id", "text", "pieces.ids"), model).select("text", "decoded.text").collect()
    assert all(r[0] == r[1] for r in read) and len(read) == 3
    assert max(limits) <= 1 << 20 and len(limits) == 2
