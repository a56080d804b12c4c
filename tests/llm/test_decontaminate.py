import random

import plain
import pytest

from cliptide.llm.decontaminate import Patterns, mark_contaminated, words


def made(seed=5):
    rng = random.Random(seed)
    vocabulary = ["a", "b", "The", "né", "x1", "日本"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(i, text(rng.randint(14, 25))) for i in range(12)] + [(50, "b"), (51, "a x1 日本"), (52, None), (53, "..."), (2, text(30))]
    docs = []
    for i in range(60):
        _, part = rng.choice(items[:12])
        docs.append((i, text(rng.randint(0, 400)) + " - " + (part if rng.random() < 0.5 else "") + "! " + text(rng.randint(0, 40)), "own"))
    return docs + [(100, None, None), (101, "", ""), (102, " .,", ""), (103, "Q " * 50_000 + items[3][1].upper() + " q" * 50_000, "")], items


@pytest.mark.parametrize("block_bytes", [1 << 20, 100])
def test_same_as_plain(spark, block_bytes):
    docs, items = made()
    rows = spark.createDataFrame(docs, "doc_id long, text string, found string")
    benchmark = spark.createDataFrame([*items, (None, "q q q")], "item_id long, text string")
    found = mark_contaminated(rows, benchmark, block_bytes=block_bytes)
    assert found.columns == ["doc_id", "text", "found", "found_"]
    got = {r.doc_id: (r.found_.n_words, r.found_.n_hit, list(r.found_["items"]), r.found_.contaminated) for r in found.collect()}
    want = plain.contamination([d[:2] for d in docs], items)
    assert got == want
    assert {r.doc_id: r.found_.items_sha256 for r in found.collect()} == {d: plain.sha(",".join(w[2])) for d, w in want.items()}


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    items = spark.createDataFrame([], "item_id long, text string")
    assert [r.found.n_hit for r in mark_contaminated(docs, items).collect()] == [0]
    assert mark_contaminated(docs.limit(0), items).count() == 0


def test_search_finds_overlapping_occurrences():
    patterns = Patterns(3)
    patterns.add("i", words(b"a a a"), 0)
    assert [start for start, _ in patterns.search(words(b"A a. a a b a a a"))] == [0, 1, 5]
