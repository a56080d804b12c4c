"""Linear maps and nearest references beyond what is broadcast."""

from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.operators import lookup, score, spectral, tiles

RNG = np.random.default_rng(9)


def cells(spark, matrix):
    rows = [(int(i), int(o), float(matrix[i, o])) for i, o in zip(*np.nonzero(matrix))]
    return spark.createDataFrame(rows, "in_idx int, out_idx int, w double").repartition(5)


@pytest.mark.parametrize("tile", [4, 16, 512])
def test_tiles_same_as_join(spark, tile):
    """Same rows and values as the broadcast join: gaps on both sides, repeated inputs, null keys and values."""
    matrix = RNG.normal(size=(37, 23)) * (RNG.random((37, 23)) < 0.3)
    rows = [(RNG.choice(["a", "b", None]), int(RNG.integers(40)), int(RNG.integers(45)), float(RNG.normal())) for _ in range(900)]
    df = spark.createDataFrame(rows, "k string, n int, i int, v double")
    want = {(r.k, r.n, r.out_idx): r.value for r in spectral.linear_map(df, matrix, ["k", "n"], "i", "v").collect()}
    out = tiles.tiled_map(df, cells(spark, matrix), ["k", "n"], "i", "v", tile=tile)
    got = {(r.k, r.n, r.out_idx): r.value for r in out.collect()}
    assert set(got) == set(want) and len(got) == out.count()
    assert max(abs(got[k] - want[k]) for k in want) < 1e-9
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "Cartesian" not in plan


def test_tiles_null_and_empty(spark):
    matrix = np.ones((3, 2))
    df = spark.createDataFrame([(1, 0, 2.0), (1, None, 5.0), (2, 1, None)], "k int, i int, v double")
    assert sorted(map(tuple, tiles.tiled_map(df, cells(spark, matrix), ["k"], "i", "v").collect())) == [(1, 0, 2.0), (1, 1, 2.0)]
    assert tiles.tiled_map(df.limit(0), cells(spark, matrix), ["k"], "i", "v").collect() == []
    assert tiles.tiled_map(df, cells(spark, matrix).limit(0), ["k"], "i", "v").collect() == []


def test_one_row_key_is_split_over_output_tiles(spark):
    matrix = RNG.normal(size=(300, 200))
    df = spark.createDataFrame([("hot", i, 1.0) for i in range(300)], "k string, i int, v double")
    got = {r.out_idx: r.value for r in tiles.tiled_map(df, cells(spark, matrix), ["k"], "i", "v", tile=64).collect()}
    np.testing.assert_allclose([got[o] for o in range(200)], matrix.sum(axis=0))


def test_large_transform_same_as_array_form(spark):
    """1,024 samples and 1,025 bins are beyond the broadcast limit."""
    wave = RNG.normal(size=1024)
    df = spark.createDataFrame([(1, i, float(v)) for i, v in enumerate(wave)], "clip int, i int, v double")
    got = {r.bin: r.magnitude for r in spectral.dft_rows(df, 1024, 2048, ["clip"], "i", "v").collect()}
    want = np.abs(np.fft.rfft(wave * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(1024) / 1024)), 2048))
    np.testing.assert_allclose([got[b] for b in range(1025)], want, atol=1e-8)


def brute(x, refs):
    if x is None or np.isnan(x) or not refs:
        return None
    return min((abs(Fraction(m) - Fraction(x)), label) for label, m in refs)[1]


@pytest.mark.parametrize("size", [1, 2, 7, 1000])
def test_nearest_same_as_brute(spark, size):
    """Ties of values and of distances, scores on boundaries and beyond both ends, nulls and NaN."""
    refs = [(f"r{i:03}", float(v)) for i, v in enumerate(RNG.integers(-40, 40, 60) / 2)] + [("r_", 3.0), ("a", 3.0)]
    scores = [*(float(x) for x in RNG.integers(-100, 100, 300) / 4), None, float("nan"), 1e300, -1e300]
    left = spark.createDataFrame(list(enumerate(scores)), "id int, score double")
    right = spark.createDataFrame([*refs, ("null", None), (None, 0.25), ("nan", float("nan"))], "name string, at double")
    got = dict(lookup.nearest_reference(left, right, "score", "name", "at", size=size).select("id", "nearest").collect())
    assert got == {i: brute(x, refs) for i, x in enumerate(scores)}


def test_nearest_without_references(spark):
    left = spark.createDataFrame([(1, 0.5)], "id int, score double")
    none = spark.createDataFrame([], "name string, at double")
    assert [tuple(r) for r in lookup.nearest_reference(left, none, "score", "name", "at").collect()] == [(1, 0.5, None)]
    assert lookup.nearest_reference(left.limit(0), left, "score", "id", "score").collect() == []


def test_many_labels_without_nested_loop(spark):
    rows = spark.range(200_000).select((F.col("id") % 100_000).alias("label"), (F.hash("id") % 1_000_000 / 100).alias("score"))
    out = score.nearest_median(rows, "label", "score")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
    sums = {}
    some = rows.collect()
    for r in some:
        sums.setdefault(r.label, []).append(r.score)
    refs = np.array([(np.median(v), k) for k, v in sums.items()])
    refs = refs[np.lexsort((refs[:, 1], refs[:, 0]))]
    for r in out.filter("label % 997 = 0").collect():
        near = np.abs(refs[:, 0] - r.score)
        assert r.nearest == refs[near == near.min(), 1].min()
