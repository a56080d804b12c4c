import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.llm import neighbours

KIND = "vec_id long, embedding array<float>, score int"


def best(rows, query, k):
    asked = np.array(dict(rows)[query], np.float64)
    away = sorted((-float(np.array(v, np.float64) @ asked), i) for i, v in rows if i != query)
    return [(i, -d) for d, i in away[:k]]


def found(spark, rows, k=20, shard_rows=300, queries=None):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], KIND)
    graphs = neighbours.index(df, shard_rows=shard_rows)
    result = {}
    for r in neighbours.search(graphs, df.filter(F.col("vec_id") % 20 == 0) if queries is None else df.filter(F.col("vec_id").isin(queries)), k=k).orderBy("query_id", "rank").collect():
        assert r["rank"] == len(result.setdefault(r.query_id, [])) + 1
        result[r.query_id].append((r.vec_id, r.score))
    return result


@pytest.mark.parametrize("lengths", [False, True])
def test_recall(spark, lengths):
    rng = np.random.default_rng(1)
    points = rng.normal(size=(1500, 16))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[200:500] = points[200] + rng.normal(size=(300, 16)) * 0.01
    if lengths:
        points *= rng.uniform(0.5, 2, (1500, 1))
    rows = [(i, p.astype(np.float32).tolist()) for i, p in enumerate(points)]
    got, hits = found(spark, rows), []
    for query in range(0, 1500, 20):
        want = best(rows, query, 20)
        hits.append(len({i for i, _ in want} & {i for i, _ in got[query]}) / 20)
        assert all(score == pytest.approx(dict(best(rows, query, 1500))[i], abs=1e-12) for i, score in got[query])
    assert np.mean(hits) >= 0.9


def test_recall_on_the_given_table(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").collect()]
    got = found(spark, rows, shard_rows=200)
    assert np.mean([len({i for i, _ in best(rows, q, 20)} & {i for i, _ in got[q]}) / 20 for q in got]) >= 0.9
    assert sorted(got) == sorted(i for i, _ in rows if i % 20 == 0)


def test_equal_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(100)] + [(i, [0.0, 1.0]) for i in range(100, 140)] + [(200, [0.5, 0.5])]
    got = found(spark, rows, k=5, shard_rows=50, queries=[0, 3, 120, 200])
    assert [i for i, _ in got[0]] == [1, 2, 3, 4, 5] and [i for i, _ in got[3]] == [0, 1, 2, 4, 5]
    assert [i for i, _ in got[120]] == [100, 101, 102, 103, 104] and [i for i, _ in got[200]] == [0, 1, 2, 3, 4]


def test_vectors_that_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (1, [2.0, 1.0]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [1.0, None]), (7, []), (None, [1.0, 1.0]), (8, [1.0]), (20, [0.0, 0.0])]
    assert found(spark, rows) == {0: [(1, 4.0)]}
    assert found(spark, [r for r in rows if r[0] in (2, 3)]) == {}
    empty = spark.createDataFrame([], KIND)
    assert neighbours.search(neighbours.index(empty), empty).count() == 0


def test_repeated_rows_are_found_once_each(spark):
    assert found(spark, [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [0.5, 0.0])], k=3) == {0: [(1, 1.0), (1, 1.0), (2, 0.5)]}


def recall(spark, points):
    rows = [(i, p.tolist()) for i, p in enumerate(points.astype(np.float32))]
    got = found(spark, rows, shard_rows=1000)
    return np.mean([len({i for i, _ in best(rows, q, 20)} & {i for i, _ in got[q]}) / 20 for q in range(0, len(rows), 20)])


@pytest.mark.parametrize("noise", [3e-2, 1e-2, 1e-3, 3e-4, 1e-4, 1e-6])
def test_recall_in_a_tight_group(spark, noise):
    rng = np.random.default_rng(4)
    points = rng.normal(size=(1500, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[::3] = points[0] + rng.normal(size=(500, 64)) * noise / 8
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    assert recall(spark, points) >= 0.95


def test_recall_beside_one_long_vector(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(size=(1500, 64))
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    points[7] *= 5000
    assert recall(spark, points) >= 0.95


def test_every_node_is_reached():
    rng = np.random.default_rng(6)
    points = np.concatenate([np.repeat(np.eye(8), 60, axis=0) + rng.normal(size=(480, 8)) * 1e-3, rng.normal(size=(40, 8))])
    graph = neighbours.build(neighbours.level_lengths(points))
    reached, ahead = {graph.entry}, [graph.entry]
    while ahead:
        near = {n for n in graph.links[0][ahead.pop()].tolist() if n >= 0} - reached
        reached |= near
        ahead += near
    assert len(reached) == len(points)


def test_more_neighbours_than_the_search_holds(spark):
    rows = [(i, v.tolist()) for i, v in enumerate(np.random.default_rng(8).normal(size=(200, 8)))]
    assert len(found(spark, rows, k=150, queries=[0])[0]) == 150
