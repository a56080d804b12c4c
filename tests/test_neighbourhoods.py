"""Neighbour graph by descent and the map made of it, against dense numpy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.operators import neighbourhoods as nb


def _table(spark, x):
    return spark.createDataFrame([(i, row.tolist(), "own") for i, row in enumerate(x)], "key long, v array<double>, src string")


def _exact(x, k):
    d = ((x[:, None] - x[None]) ** 2).sum(axis=2)
    np.fill_diagonal(d, np.inf)
    return {(i, int(j)) for i in range(len(x)) for j in np.argsort(d[i], kind="stable")[:k]}


def _cloud(n=500):
    return np.random.default_rng(3).normal(0, 1, (n, 3)) * [3, 2, 1]


def _edges(graph):
    return {(r.src, r.dst) for r in graph.collect()}


def test_one_block_is_exact(spark):
    x = _cloud(120)
    assert _edges(nb.neighbour_graph(_table(spark, x), "key", "v", k=5)) == _exact(x, 5)


def test_descent_finds_neighbours_across_blocks(spark, monkeypatch):
    monkeypatch.setattr(nb, "BLOCK", 40)
    draw = np.random.default_rng(4)
    x = np.concatenate([draw.normal(0, 1, (400, 16)), np.tile(draw.normal(0, 1, 16), (200, 1)) + draw.normal(0, 1e-3, (200, 16))])
    graph = nb.neighbour_graph(_table(spark, x), "key", "v", k=10)
    found, want = _edges(graph), _exact(x, 10)
    assert len(found) == 6000 and len(found & want) > 0.9 * len(want)
    for r in graph.limit(50).collect():
        assert r.d2 == pytest.approx(((x[r.src] - x[r.dst]) ** 2).sum())


def test_neighbourhoods_that_stay_bring_no_vectors(spark, monkeypatch):
    """Leaving them out changes no edge, nor does leaving out edges that are too long; floats are carried as floats and compared as doubles."""
    monkeypatch.setattr(nb, "BLOCK", 30)
    x = np.random.default_rng(6).normal(0, 1, (200, 8)).astype(np.float32)
    df = _table(spark, x).withColumn("v", F.col("v").cast("array<float>"))
    graph = lambda df: {(r.src, r.dst): r.d2 for r in nb.neighbour_graph(df, "key", "v", k=5).collect()}
    brought, met = [], nb._met

    def counted(around, before, rows, far, k):
        assert rows.schema["v"].dataType.simpleString() == "array<float>"
        brought.append(met(around, before, rows, far.withColumn("far", F.lit(None).cast("double")), k).select("src").distinct().count())
        assert met(around, before, rows, far, k).join(far.withColumnRenamed("id", "src"), "src").filter("d2 > far").count() == 0
        return met(around, before, rows, far, k)

    monkeypatch.setattr(nb, "_met", counted)
    some = graph(df)
    assert brought[0] == 200 and brought[-1] < 200
    last = spark.createDataFrame([(*e, d) for e, d in some.items()], "src long, dst long, d2 double")
    around = nb._neighbourhoods(last, 5)
    assert met(around, around, df.selectExpr("key AS id", "v"), nb._reach(last, 5), 5).count() == 0
    monkeypatch.setattr(nb, "_met", lambda around, before, rows, far, k: met(around, None, rows, far.withColumn("far", F.lit(None).cast("double")), k))
    assert graph(df) == some
    assert graph(df.withColumn("v", F.col("v").cast("array<double>"))) == some


def test_map_same_as_dense_numpy(spark, monkeypatch):
    """500 rows: the vectors agree with those of the dense matrix of the same graph, up to sign."""
    df = _table(spark, _cloud())
    graph = nb.neighbour_graph(df, "key", "v", k=8)
    edges, degrees = nb.normalised_adjacency(graph)
    vectors, values = nb.leading_vectors(edges, degrees, 3, tolerance=1e-9)
    w = np.zeros((500, 500))
    for a, b in _edges(graph):
        w[a, b] += 0.5
        w[b, a] += 0.5
    degree = w.sum(axis=1)
    value, vector = np.linalg.eigh(w / np.sqrt(np.outer(degree, degree)))
    rows = vectors.orderBy("id").collect()
    got = np.array([[r[f"y{j}"] for j in range(3)] for r in rows])
    np.testing.assert_allclose(values, value[::-1][1:4], atol=1e-8)
    want = vector[:, ::-1][:, 1:4]
    np.testing.assert_allclose(got * np.sign((got * want).sum(axis=0)), want, atol=1e-6)
    assert (got[np.abs(got).argmax(axis=0), range(3)] > 0).all()
    monkeypatch.setattr(nb, "neighbour_graph", lambda *a, **b: graph)
    at = {r.key: r.axis1 for r in nb.neighbour_map(df, "key", "v", 1, tolerance=1e-8).collect()}
    np.testing.assert_allclose([at[i] for i in range(500)], got[:, 0] / np.sqrt(degree), atol=1e-5)


def test_groups_apart_lie_apart(spark):
    """Two components: the first axis is constant in each and differs between them."""
    draw = np.random.default_rng(5)
    x = np.concatenate([draw.normal(0, 1, (40, 3)), draw.normal(100, 1, (60, 3))])
    at = {r.key: r.axis1 for r in nb.neighbour_map(_table(spark, x), "key", "v", 1, k=6, tolerance=1e-9).collect()}
    first, second = np.array([at[i] for i in range(40)]), np.array([at[i] for i in range(40, 100)])
    assert np.ptp(first) < 1e-6 and np.ptp(second) < 1e-6 and abs(first.mean() - second.mean()) > 1e-3


def test_edges_of_the_input(spark):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0]), (4, None), (5, []), (6, [float("nan"), 0.0]), (7, [None, 1.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "key long, v array<double>")
    one = _edges(nb.neighbour_graph(df, "key", "v", k=1))
    assert sorted(a for a, _ in one) == [1, 2, 3] and all(a != b and b in (1, 2, 3) for a, b in one)
    copies = _table(spark, np.ones((700, 2)))
    into = nb.neighbour_graph(copies, "key", "v", k=5).groupBy("dst").count().agg({"count": "max"}).first()[0]
    assert into <= 25  # no copy is the neighbour of all
    assert nb.neighbour_graph(df.limit(0), "key", "v").count() == 0
    assert nb.neighbour_graph(df.filter("key = 1"), "key", "v").count() == 0
    with pytest.raises(ValueError, match="at least two"):
        nb.neighbour_map(df.filter("key = 1"), "key", "v")
    with pytest.raises(ValueError, match="vectors of"):
        nb.neighbour_graph(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "key long, v array<double>"), "key", "v")
