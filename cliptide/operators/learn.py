"""Model work on spark.ml: fold-wise evaluation, pooled sequences, search, projection."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.ml import Estimator, Pipeline
from pyspark.ml.classification import LinearSVC, LogisticRegression
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.feature import PCA, StandardScaler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators.evaluate import binary_metrics, mean_over_folds
from cliptide.operators.exact import hash_key, names, settled
from cliptide.operators.sample import held_out_rows, train_rows


def as_vector(df: DataFrame, values: str, name: str = "features") -> DataFrame:
    return df.withColumn(name, array_to_vector(F.col(values).cast("array<double>")))


def linear_classifier(scaled: bool = True) -> Pipeline:
    """Linear support-vector classifier, on standardised features by default."""
    svc = LinearSVC(featuresCol="_scaled" if scaled else "features", labelCol="label", maxIter=10, regParam=0.01)
    scaler = StandardScaler(inputCol="features", outputCol="_scaled", withMean=True)
    return Pipeline(stages=[scaler, svc] if scaled else [svc])


def _rows(values: pd.Series) -> np.ndarray:
    return np.stack([np.asarray(v, np.float64) for v in values])


def fourier_features(values: Column, width: int, outputs: int = 128, gamma: float | None = None, seed: int = 42) -> Column:
    """Random cosine features that approximate the radial kernel exp(-gamma·d²); ``gamma``
    defaults to 1/width. One matrix product for each Arrow batch; the matrix follows from its parameters."""
    draw = np.random.default_rng(seed)
    matrix = draw.normal(0.0, (2 * (gamma or 1.0 / width)) ** 0.5, (outputs, width))
    shift = draw.uniform(0.0, 2 * np.pi, outputs)

    @F.pandas_udf("array<double>")
    def mapped(batch: pd.Series) -> pd.Series:
        if batch.empty:
            return pd.Series([], dtype=object)
        return pd.Series(list(np.cos(_rows(batch) @ matrix.T + shift) * (2.0 / outputs) ** 0.5))

    return mapped(values)


@dataclass
class RadialFeatures:
    """Nyström features of the kernel exp(-gamma·d²): the kernel between a row and the landmarks, whitened, so
    that inner products of features are the kernel itself between landmarks and close to it elsewhere."""

    landmarks: np.ndarray
    whitening: np.ndarray
    gamma: float

    @classmethod
    def of(cls, landmarks: np.ndarray, gamma: float, least: float = 1e-10) -> RadialFeatures:
        """Directions whose eigenvalue is below ``least`` of the largest are left out: equal landmarks
        would divide by zero."""
        value, vector = np.linalg.eigh(_kernel(landmarks, landmarks, gamma))
        kept = value > least * value.max()
        return cls(landmarks, vector[:, kept] / np.sqrt(value[kept]), gamma)

    def matrix(self, rows: np.ndarray) -> np.ndarray:
        return _kernel(rows, self.landmarks, self.gamma) @ self.whitening

    def column(self, values: Column) -> Column:
        @F.pandas_udf("array<double>")
        def mapped(batch: pd.Series) -> pd.Series:
            return pd.Series([], dtype=object) if batch.empty else pd.Series(list(self.matrix(_rows(batch))))

        return mapped(values)


def _kernel(a: np.ndarray, b: np.ndarray, gamma: float) -> np.ndarray:
    near = (a**2).sum(axis=1)[:, None] + (b**2).sum(axis=1)[None, :] - 2 * a @ b.T
    return np.exp(-gamma * np.maximum(near, 0))


def radial_features(df: DataFrame, values: str, key: str | Sequence[str], outputs: int = 128, gamma: float | None = None, seed: int = 42) -> RadialFeatures:
    """Features fitted on ``df``: its ``outputs`` rows that come first in the seeded hash order of ``key`` are the
    landmarks, all that reaches the driver. ``gamma`` defaults to 1 / number of values."""
    first = df.filter(F.col(values).isNotNull()).orderBy(hash_key(seed, *names(key)), *names(key)).limit(outputs)
    rows = first.select(F.col(values).cast("array<double>")).collect()
    if not rows:
        raise ValueError("no row to take landmarks from")
    landmarks = _rows(pd.Series([r[0] for r in rows]))
    return RadialFeatures.of(landmarks, gamma or 1.0 / landmarks.shape[1])


def radial_preparation(values: str, key: str | Sequence[str], outputs: int = 128, gamma: float | None = None, seed: int = 42):
    """For ``fold_predictions``: landmarks from a fold's training rows only, then vectors of features."""

    def fit(train: DataFrame):
        features = radial_features(train, values, key, outputs, gamma, seed)
        return lambda df: df.withColumn("features", array_to_vector(features.column(F.col(values).cast("array<double>"))))

    return fit


def fold_predictions(
    df: DataFrame, folds: int, estimator: Estimator | None = None, fold: str = "fold", keep: Sequence[str] = (),
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Out-of-fold predictions: one fit per fold on the other folds, all folds.

    ``prepare`` is fitted on the training rows of each fold and then maps these and the held-out ones.
    The thin predictions are written below the shared folder, while the rows are still cached.
    """
    estimator = estimator or linear_classifier()
    # A fit is hundreds of small jobs, and every task reports to the driver: rows that are read back come in as many
    # tasks as their bytes fill, not in one for each shuffle partition of what made them.
    # A fit reads its rows many times; the cache falls back to disk and is rebuilt when lost.
    df = settled(df, "fold_rows").persist()
    parts = []
    try:
        for held_out in range(folds):
            train, test = train_rows(df, held_out, fold), held_out_rows(df, held_out, fold)
            if prepare:
                mapped = prepare(train)
                train, test = mapped(train).persist(), mapped(test)
            scored = estimator.fit(train).transform(test)
            parts.append(
                scored.select(*keep, fold, F.col("label").cast("int").alias("y_true"), F.col("prediction").cast("int").alias("y_pred"))
            )
            if prepare:
                train.unpersist()
        return settled(reduce(DataFrame.unionByName, parts), "fold_predictions")
    finally:
        df.unpersist()


def fold_metrics(
    df: DataFrame, folds: int, estimator: Estimator | None = None, fold: str = "fold", positive_class: int = 1,
    prepare: Callable[[DataFrame], Callable[[DataFrame], DataFrame]] | None = None,
) -> DataFrame:
    """Metrics of every fold, and ``mean_over_folds`` of them under fold NULL."""
    each = binary_metrics(fold_predictions(df, folds, estimator, fold, prepare=prepare), [fold], positive_class=positive_class)
    metrics = ["accuracy", "precision", "recall", "f1"]
    each = each.select(fold, *metrics)
    return each.unionByName(mean_over_folds(each, [], metrics), allowMissingColumns=True)


def pooled(df: DataFrame, frames: str = "frames", name: str = "features") -> DataFrame:
    """Mean and maximum over the frames of a sequence, as one vector: a narrow step."""
    n = F.size(frames)
    first = F.transform(F.get(F.col(frames), F.lit(0)), lambda x: x.cast("double"))
    rest = F.slice(F.col(frames), F.lit(2), F.greatest(n - 1, F.lit(0)))
    sums = F.aggregate(rest, first, lambda acc, f: F.zip_with(acc, f, lambda a, b: a + b.cast("double")))
    tops = F.aggregate(rest, first, lambda acc, f: F.zip_with(acc, f, lambda a, b: F.greatest(a, b.cast("double"))))
    values = F.concat(F.transform(sums, lambda s: s / n), tops)
    return df.filter(n > 0).withColumn(name, array_to_vector(values))


def pooled_classifier() -> LogisticRegression:
    return LogisticRegression(featuresCol="features", labelCol="label", maxIter=20, regParam=0.01)


def search(df: DataFrame, estimator: LogisticRegression | None = None, reg: Sequence[float] = (0.001, 0.01, 0.1), mix: Sequence[float] = (0.0,), folds: int = 4, fold: str = "fold", metric: str = "f1", parallelism: int = 4):
    """Grid search with the given fold column; returns the fitted cross-validation model."""
    estimator = estimator or pooled_classifier()
    grid = ParamGridBuilder().addGrid(estimator.regParam, list(reg)).addGrid(estimator.elasticNetParam, list(mix)).build()
    judge = MulticlassClassificationEvaluator(labelCol="label", metricName=metric)
    validator = CrossValidator(
        estimator=estimator, estimatorParamMaps=grid, evaluator=judge, numFolds=folds, foldCol=fold, parallelism=parallelism
    )
    df = df.persist()
    fitted = validator.fit(df)
    df.unpersist()
    return fitted


def search_table(spark, fitted) -> DataFrame:
    """One row per parameter setting of ``search``, with its mean metric and whether it won."""
    settings = [{p.name: float(v) for p, v in m.items()} for m in fitted.getEstimatorParamMaps()]
    best = int(np.argmax(fitted.avgMetrics))
    rows = [
        (s["regParam"], s["elasticNetParam"], float(m), i == best)
        for i, (s, m) in enumerate(zip(settings, fitted.avgMetrics))
    ]
    return spark.createDataFrame(rows, "reg_param double, elastic_net double, metric double, best boolean")


def projection(df: DataFrame, values: str, dims: int = 2, keep: Sequence[str] = ()) -> DataFrame:
    """First principal components of frame embeddings. Linear: it shows spread, not neighbourhoods."""
    vectors = as_vector(df, values, "_features")
    model = PCA(k=dims, inputCol="_features", outputCol="_pc").fit(vectors)
    axes = vector_to_array("_pc")
    return model.transform(vectors).select(*keep, *[axes[i].alias(f"pc{i + 1}") for i in range(dims)])
