import random

import numpy as np
import plain

from cliptide.llm import suffix_dedup


def check(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, cut string").repartition(3)
    found = {r.doc_id: (r.cut.n_bytes, r.cut.n_removed, len(r.cut.spans), bytes(r.cut.kept)) for r in suffix_dedup.remove_repeats(df).collect()}
    assert found == plain.remove_repeats(rows)


def test_same_as_plain(spark):
    rng = random.Random(5)
    text = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    passages = [text("abcdef ", rng.randint(90, 300)) for _ in range(6)]
    rows = []
    for i in range(150):
        parts = [rng.choice([rng.choice(passages)[rng.randint(0, 40) :], text("abcdé ", rng.randint(0, 120)), "ab" * rng.randint(0, 120)]) for _ in range(rng.randint(0, 4))]
        rows.append((i, "".join(parts)))
    check(spark, rows + [(500, None), (501, ""), (502, "a" * 4000), (503, "b" * 99), (504, "c" * 100), (505, "c" * 100)])


def test_one_passage_in_many_surroundings(spark):
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdefghij") for _ in range(n))
    passage = text(180)
    check(spark, [(i, text(80) + passage + text(80)) for i in range(120)])


def test_long_texts_are_read_in_pieces(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "SLICE_BYTES", 500)
    monkeypatch.setattr(suffix_dedup, "WINDOWS_AT_ONCE", 300)
    rng = random.Random(2)
    passage = "".join(rng.choice("abcdefghij") for _ in range(1200))
    check(spark, [(1, passage + "-" + passage), (2, "x" + passage[100:900] + "y" + passage), (3, passage)])


def test_empty_repeated_and_null_ids(spark):
    assert suffix_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    body = "0123456789" * 9 + "abcdefghijkl"
    rows = [(1, body), (1, body), (2, body), (None, body)]
    found = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.cut.n_removed) for r in found) == [(0, 0), (1, 0), (1, 0), (2, len(body))]


def test_classes_of_equal_windows():
    rng = np.random.default_rng(3)
    base = rng.integers(97, 99, (30, 100), dtype=np.uint8)
    alike = base[rng.integers(0, 30, 200)].copy()
    alike[:50, 60:] = base[0, 60:]
    alike[50:60, :99] = base[0, :99]
    windows = np.concatenate([base, alike])
    classes = suffix_dedup.sort_classes(windows)
    by_row = {}
    for row, name in zip(windows, classes.tolist()):
        by_row.setdefault(row.tobytes(), set()).add(name)
    assert all(len(names) == 1 for names in by_row.values()) and len(set(classes.tolist())) == len(by_row)


def test_packing():
    rows = np.zeros(5, suffix_dedup.ANCHOR)
    rows["anchor"], rows["whole"], rows["at"], rows["n"] = np.arange(5) << 40, np.arange(5), 7, 77
    for docs in ([3, 1, 2, 9, 9], [-(1 << 40), 5, 1 << 40, 0, 1]):
        rows["doc"] = docs
        assert (suffix_dedup.unpack(suffix_dedup.pack(rows)) == rows).all()
