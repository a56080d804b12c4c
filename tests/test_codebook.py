"""Pooling against a codebook: k-means and residuals as in plain numpy, order and modes of frames kept."""

import hashlib

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cliptide.operators import codebook, learn, sample


def test_learned_as_in_numpy(spark):
    rng = np.random.default_rng(3)
    rows = {i: rng.normal(0, 1, 3) + 4 * (i % 4) for i in range(200)}
    df = spark.createDataFrame([(i, v.tolist()) for i, v in rows.items()] + [(999, None)], "id int, v array<double>")
    order = sorted(rows, key=lambda i: (hashlib.md5(f"42:{i}".encode()).hexdigest(), i))
    words, x = np.array([rows[i] for i in order[:5]]), np.array(list(rows.values()))
    for _ in range(4):
        near = ((x[:, None] - words[None]) ** 2).sum(axis=2).argmin(axis=1)
        words = np.array([x[near == k].mean(axis=0) if (near == k).any() else words[k] for k in range(5)])
    np.testing.assert_allclose(codebook.learn_codebook(df.repartition(7), "v", "id", 5, 4).words, words)


def test_equal_rows_few_rows_and_none(spark):
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id int, v array<double>")
    assert codebook.learn_codebook(same, "v", "id", 3).words.tolist() == [[1.0, 2.0]] * 3
    assert len(codebook.learn_codebook(same.limit(2), "v", "id", 3).words) == 2
    with pytest.raises(ValueError, match="no row"):
        codebook.learn_codebook(same.limit(0), "v", "id", 3)


def test_tasks_without_rows(spark):
    rows = spark.createDataFrame([(i, [float(i), 0.0]) for i in range(3)], "id int, v array<double>").repartition(32)
    assert codebook.learn_codebook(rows, "v", "id", 1, 1).words.tolist() == [[1.0, 0.0]]
    book = codebook.learn_codebook(rows, "v", "id", 3)
    empty = rows.filter("id > 5").select(book.column(F.array("v")).alias("v"))
    assert sorted(book.words[:, 0]) == [0.0, 1.0, 2.0] and empty.collect() == []


def test_residuals(spark):
    book = codebook.Codebook(np.array([[0.0, 0.0], [10.0, 10.0]]))
    rows = [(1, [[1.0, 0.0], [9.0, 10.0], [0.0, 2.0], [12.0, 10.0]]), (2, [[5.0, 5.0]]), (3, []), (4, None), (5, [None, [10.0, 11.0]])]
    df = spark.createDataFrame(rows, "id int, frames array<array<float>>")
    got = {r.id: r.v for r in codebook.residual_pooled(df, book, parts=1).select("id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: [0.25, 0.5, 0.25, 0.0], 2: [5.0, 5.0, 0.0, 0.0], 5: [0.0, 0.0, 0.0, 1.0]}
    halves = {r.id: r.v for r in df.select("id", book.column(F.col("frames"), 2).alias("v")).collect()}
    assert halves[1] == [0.25, 0.0, -0.25, 0.0, 0.0, 0.5, 0.5, 0.0] and halves[3] == [0.0] * 8 and halves[4] is None


def test_modes_that_mean_and_maximum_lose(spark):
    """Two kinds of sequences with the same mean and the same maximum of their frames."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(160):
        ends = [[3.0, 3.0], [-3.0, -3.0], [3.0, -3.0], [-3.0, 3.0]]
        kinds = [ends[0], ends[1], ends[0], ends[1]] if i % 2 else [ends[2], ends[3], ends[2], ends[3]]
        rows.append((i, float(i % 2), [(np.array(k) + rng.normal(0, 0.3, 2)).tolist() for k in kinds]))
    df = sample.shuffled_folds(spark.createDataFrame(rows, "id long, label double, frames array<array<double>>"), "id")
    score = lambda found: np.mean([r.y_true == r.y_pred for r in found.collect()])
    prepare = codebook.residual_preparation("id", words=2, rounds=3, parts=1)
    found = learn.fold_predictions(df, 4, learn.pooled_classifier(), keep=["id"], prepare=prepare)
    plain = score(learn.fold_predictions(learn.pooled(df), 4, learn.pooled_classifier(), keep=["id"]))
    assert found.select("id").distinct().count() == 160
    assert score(found) > plain
