"""Feature maps and pooling; the fitted models themselves are spark.ml's."""

import numpy as np
import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from cliptide.operators import learn, sample


def test_fourier_features_approximate_the_kernel(spark):
    x = np.random.default_rng(0).normal(0, 1, (6, 4))
    df = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "id int, v array<double>")
    z = df.select("id", learn.fourier_features(F.col("v"), 4, outputs=400, gamma=0.2).alias("z")).orderBy("id").collect()
    z = np.array([r.z for r in z])
    kernel = np.exp(-0.2 * ((x[:, None] - x[None]) ** 2).sum(axis=2))
    assert np.abs(z @ z.T - kernel).max() < 0.2


def test_pooled(spark):
    df = spark.createDataFrame([(1, [[1.0, 5.0], [3.0, -1.0]]), (2, [[4.0, 4.0]]), (3, [])], "id int, frames array<array<float>>")
    got = {r.id: r.v for r in learn.pooled(df).select("id", vector_to_array("features").alias("v")).collect()}
    assert got == {1: [2.0, 2.0, 3.0, 5.0], 2: [4.0] * 4}


def test_fold_predictions_cover_every_row_once(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(i % 2), i % 3, (rng.normal(0, 0.1, 2) + (i % 2)).tolist()) for i in range(60)]
    df = learn.as_vector(spark.createDataFrame(rows, "id int, label double, fold int, v array<double>"), "v")
    found = learn.fold_predictions(df, 3, learn.pooled_classifier(), keep=["id"]).collect()
    assert sorted(r.id for r in found) == list(range(60))
    assert all(r.y_true == r.y_pred for r in found)


def _ring(spark, n=600):
    rng = np.random.default_rng(6)
    angle, radius = rng.uniform(0, 2 * np.pi, n), np.where(np.arange(n) % 2, 1.0, 3.0) + rng.normal(0, 0.2, n)
    rows = [(i, float(i % 2), [float(r * np.cos(a)), float(r * np.sin(a))]) for i, (a, r) in enumerate(zip(angle, radius))]
    return sample.shuffled_folds(learn.as_vector(spark.createDataFrame(rows, "id long, label double, at array<double>"), "at"), "id")


def test_radial_kernel_separates_a_ring(spark):
    df = _ring(spark)
    accuracy = lambda rows: {r.fold: r.accuracy for r in rows.collect()}[None]
    prepare = learn.radial_preparation("at", "id", outputs=40, gamma=0.5)
    assert accuracy(learn.fold_metrics(df, 4, learn.linear_classifier(False), prepare=prepare)) > 0.97
    assert accuracy(learn.fold_metrics(df, 4)) < 0.7


def test_radial_features_same_as_numpy(spark):
    """Landmarks by hash order; features by the definition: inner products give the kernel between landmarks."""
    import hashlib

    df = _ring(spark, 80).select("id", "at")
    made = learn.radial_features(df, "at", "id", outputs=12, gamma=0.7)
    rows = {r.id: np.array(r["at"]) for r in df.collect()}
    first = sorted(rows, key=lambda i: hashlib.md5(f"42:{i}".encode()).hexdigest())[:12]
    marks = np.array([rows[i] for i in first])
    np.testing.assert_allclose(made.landmarks, marks)
    kernel = lambda a, b: np.exp(-0.7 * ((a[:, None, :] - b[None, :, :]) ** 2).sum(axis=2))
    value, vector = np.linalg.eigh(kernel(marks, marks))
    got = {r.id: np.array(r.f) for r in df.select("id", made.column(F.col("at")).alias("f")).collect()}
    for i, x in rows.items():
        want = kernel(x[None, :], marks) @ (vector / np.sqrt(value))
        np.testing.assert_allclose(np.abs(got[i]), np.abs(want[0][-len(got[i]) :]), atol=1e-6)
    f = np.array([got[i] for i in first])
    np.testing.assert_allclose(f @ f.T, kernel(marks, marks), atol=1e-6)


def test_radial_features_with_repeated_rows(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(9)], "id long, at array<double>")
    made = learn.radial_features(df, "at", "id", outputs=5)
    assert made.whitening.shape == (5, 1) and np.isfinite(made.matrix(np.ones((2, 2)))).all()
    with pytest.raises(ValueError):
        learn.radial_features(df.limit(0), "at", "id")


def test_search_and_fold_predictions(spark):
    """Every row is predicted once, in its own fold; the best setting has the largest metric."""
    df = _ring(spark, 120)
    out = learn.fold_predictions(df, 4, keep=["id"]).collect()
    assert {(r.id, r.fold) for r in out} == {(r.id, r.fold) for r in df.collect()} and len(out) == 120
    table = learn.search_table(spark, learn.search(df, reg=(0.01, 0.1))).collect()
    assert len(table) == 2 and max(table, key=lambda r: r.metric).metric == next(r.metric for r in table if r.best)


def test_fold_rows_come_in_as_many_tasks_as_their_bytes_fill(spark):
    rows = spark.createDataFrame([(i, float(i % 2), [float(i % 2), float(i)], i % 4) for i in range(400)], "id long, label double, v array<double>, fold int")
    seen = []

    def prepare(train):
        seen.append((train.rdd.getNumPartitions(), train.count()))
        return lambda df: learn.as_vector(df, "v")

    found = learn.fold_predictions(rows.repartition(64, "id"), 4, keep=["id"], prepare=prepare)
    assert [n for _, n in seen] == [300] * 4 and max(p for p, _ in seen) <= 16
    assert found.select("id").distinct().count() == found.count() == 400
