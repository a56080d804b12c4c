"""Metrics, reports, profiles, histograms and densities."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.operators.exact import attach, exact_median, names


def _ratio(top: Column, bottom: Column) -> Column:
    return F.coalesce(F.try_divide(top.cast("double"), bottom.cast("double")), F.lit(0.0))


def binary_metrics(df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", predicted: str = "y_pred", positive_class: int = 1) -> DataFrame:
    """Accuracy, precision, recall, F1, specificity per group, in one aggregation; 0 where
    undefined. Several test sets are groups of one job."""
    t, p = F.col(truth) == positive_class, F.col(predicted) == positive_class
    counts = df.groupBy(*by).agg(
        F.count_if(t & p).alias("tp"),
        F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"),
        F.count_if(~t & ~p).alias("tn"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return counts.select(
        *by,
        "tn", "fp", "fn", "tp",
        _ratio(tp + tn, tp + tn + fp + fn).alias("accuracy"),
        _ratio(tp, tp + fp).alias("precision"),
        _ratio(tp, tp + fn).alias("recall"),
        _ratio(tp * 2, tp * 2 + fp + fn).alias("f1"),
        _ratio(tn, tn + fp).alias("specificity"),
    )


def confusion(df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", predicted: str = "y_pred", classes: Sequence[int] = (0, 1)) -> DataFrame:
    """One row per true class, one count column per predicted class."""
    table = df.groupBy(*by, truth).pivot(predicted, list(classes)).count()
    return table.select(
        *by, truth, *[F.coalesce(F.col(str(c)), F.lit(0)).alias(f"pred_{c}") for c in classes]
    )


def classification_report(df: DataFrame, by: Sequence[str] = (), truth: str = "y_true", predicted: str = "y_pred") -> DataFrame:
    """Per-class precision, recall, F1 and support, with rows for accuracy, the plain mean and
    the support-weighted mean. Everything follows from the small table of (truth, prediction)
    counts."""
    by = list(by)
    cells = df.groupBy(*by, F.col(truth).alias("_t"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    zero = F.lit(0).cast("bigint")
    sides = F.array(
        F.struct(
            F.col("_t").alias("c"),
            F.col("_n").alias("support"),
            zero.alias("claimed"),
            F.when(F.col("_t") == F.col("_p"), F.col("_n")).otherwise(zero).alias("hit"),
        ),
        F.struct(F.col("_p").alias("c"), zero.alias("support"), F.col("_n").alias("claimed"), zero.alias("hit")),
    )
    per_class = (
        cells.select(*by, F.inline(sides))
        .groupBy(*by, "c")
        .agg(F.sum("support").alias("support"), F.sum("claimed").alias("claimed"), F.sum("hit").alias("hit"))
        .select(
            *by,
            "c",
            "support",
            "hit",
            _ratio(F.col("hit"), F.col("claimed")).alias("precision"),
            _ratio(F.col("hit"), F.col("support")).alias("recall"),
            _ratio(F.col("hit") * 2, F.col("claimed") + F.col("support")).alias("f1"),
        )
    )
    metrics = ("precision", "recall", "f1")
    rows = per_class.select(*by, F.col("c").cast("string").alias("row"), *metrics, "support")
    n = F.sum("support")
    accuracy = _ratio(F.sum("hit"), n)
    weighted = lambda m: _ratio(F.sum(F.col(m) * F.col("support")), n).alias(m)
    means = per_class.groupBy(*by).agg(
        F.array(
            F.struct(F.lit("accuracy").alias("row"), *[accuracy.alias(m) for m in metrics], n.alias("support")),
            F.struct(F.lit("macro avg").alias("row"), *[F.avg(m).alias(m) for m in metrics], n.alias("support")),
            F.struct(F.lit("weighted avg").alias("row"), *[weighted(m) for m in metrics], n.alias("support")),
        ).alias("_rows")
    )
    return rows.unionByName(means.select(*by, F.inline("_rows")))


def mean_over_folds(df: DataFrame, by: Sequence[str], metrics: Sequence[str] = ("accuracy", "precision", "recall", "f1")) -> DataFrame:
    return df.groupBy(*by).agg(*[F.avg(m).alias(m) for m in metrics])


def comparison_table(df: DataFrame, model: str = "model", metrics: Sequence[str] = ("accuracy", "precision", "f1", "recall"), models: Sequence[str] | None = None) -> DataFrame:
    """Metric × model, from one row of metrics per model."""
    long = df.select(model, F.inline(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).alias("v")) for m in metrics])))
    return long.groupBy("metric").pivot(model, list(models) if models else None).agg(F.max("v"))


# --- profiles ----------------------------------------------------------------------------


def corpus_profile(df: DataFrame, rate: str = "sr", channels: str = "channels", error: str = "error") -> DataFrame:
    """Files per sample rate, with the down-mixed and the failed ones; failures have no rate."""
    return df.groupBy(F.when(F.col(error).isNull(), F.col(rate)).alias("sample_rate")).agg(
        F.count(F.lit(1)).alias("files"),
        F.count_if(F.col(error).isNotNull()).alias("failed"),
        F.count_if(F.col(error).isNull() & (F.col(channels) > 1)).alias("mono_converted"),
    )


def duration_totals(df: DataFrame, known: Mapping[str, Sequence[str]], duration: str = "duration", class_label: str = "class_label") -> DataFrame:
    """Minutes per speaker, microphone, class and (class 1 only) category in one pass.

    ``known`` lists the values to report per dimension; those without clips get 0.
    """
    spark = df.sparkSession
    dims = list(known)
    narrowed = df.select(
        *[
            (F.when(F.col(class_label) == 1, F.col(d)) if d == "category" else F.col(d)).cast("string").alias(d)
            for d in dims
        ],
        F.round(F.col(duration) / 60, 2).alias("_minutes"),
    )
    totals = (
        narrowed.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims])
        .agg(F.sum("_minutes").alias("_m"), *[F.grouping(d).alias(f"_g_{d}") for d in dims])
        .select(
            F.explode(
                F.filter(
                    F.array(*[
                        F.when(F.col(f"_g_{d}") == 0, F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")))
                        for d in dims
                    ]),
                    lambda c: c.isNotNull(),
                )
            ).alias("_c"),
            "_m",
        )
        .select("_c.*", "_m")
    )
    wanted = spark.createDataFrame([(d, str(v)) for d in dims for v in known[d]], "dimension string, value string")
    return wanted.join(totals, ["dimension", "value"], "left").select(
        "dimension", "value", F.coalesce("_m", F.lit(0.0)).alias("minutes")
    )


def last_value(df: DataFrame, key: str, value: str, order: str | Sequence[str]) -> DataFrame:
    """Value of the last row of each key (combined map-side)."""
    return df.groupBy(key).agg(F.max_by(value, F.struct(*names(order))).alias(value))


def run_summary(df: DataFrame, total: str = "filename", label: str = "tv", error: str = "error") -> DataFrame:
    """Processed, total and positive clips of a scoring run. A clip that failed or has no label
    is counted in the total only."""
    done = F.col(error).isNull() & F.col(label).isNotNull()
    return df.agg(
        F.count_if(done).alias("processed"),
        F.count(total).alias("total"),
        F.count_if(done & (F.col(label) == 1)).alias("positive"),
    )


def median_per_label(df: DataFrame, label: str = "label", score: str = "score", name: str = "median") -> DataFrame:
    return exact_median(df.filter(F.col(label).isNotNull()), label, score, name)


def robust_centre(df: DataFrame, by: str | Sequence[str], value: str, limit: float = 3.0, name: str = "centre") -> DataFrame:
    """Median of the values within ``limit`` population deviations of the group mean.

    A constant group keeps no value and gets NULL with a note, as the deviation is undefined.
    """
    by = names(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    stats = rows.groupBy(*by).agg(F.avg("_x").alias("_mean"), F.stddev_pop("_x").alias("_sigma"))
    kept = rows.join(stats, by).filter(F.abs(F.col("_x") - F.col("_mean")) < F.col("_sigma") * F.lit(limit))
    centre = exact_median(kept, by, "_x", name, few=False)
    note = F.when(F.col(name).isNull(), "constant series")
    return stats.select(*by).join(centre, by, "left").withColumn("error", note)


# --- distributions -----------------------------------------------------------------------


def histogram(df: DataFrame, by: str | Sequence[str], value: str, bins: int) -> DataFrame:
    """Counts per equal-width bin over each group's own range; empty bins are left out.

    Bins are closed on the left, the last one on both sides; a single-valued range is widened
    by 0.5 each way. Bin edges decide membership, so rounding in the division does not.
    """
    by = names(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    flat = F.min("_x") == F.max("_x")
    ranges = rows.groupBy(*by).agg(
        F.when(flat, F.min("_x") - 0.5).otherwise(F.min("_x")).alias("lo"),
        F.when(flat, F.max("_x") + 0.5).otherwise(F.max("_x")).alias("hi"),
    )
    step = (F.col("hi") - F.col("lo")) / F.lit(bins)
    guess = F.least(F.floor((F.col("_x") - F.col("lo")) / step), F.lit(bins - 1))
    edge = lambda i: F.col("lo") + i * step
    settled = (
        F.when(F.col("_x") < edge(F.col("_g")), F.col("_g") - 1)
        .when((F.col("_x") >= edge(F.col("_g") + 1)) & (F.col("_g") < bins - 1), F.col("_g") + 1)
        .otherwise(F.col("_g"))
    )
    return (
        attach(rows, ranges, by)
        .withColumn("_g", guess)
        .groupBy(*by, "lo", "hi", settled.alias("bin"))
        .agg(F.count(F.lit(1)).alias("n"))
        .select(*by, "bin", edge(F.col("bin")).alias("left"), edge(F.col("bin") + 1).alias("right"), "n")
    )


def density(df: DataFrame, by: str | Sequence[str], value: str, points: int = 50, cut: float = 3.0, bandwidth: float | None = None) -> DataFrame:
    """Gaussian kernel density per group, on an even grid from ``cut`` bandwidths below the
    smallest value to ``cut`` above the largest.

    The bandwidth follows Scott's rule (sample deviation · n^-1/5) unless given. Equal values
    are merged first; each batch of rows then gives one partial sum per group and grid point,
    so rows are never multiplied by the grid.
    """
    by = names(by)
    merged = (
        df.select(*by, F.col(value).cast("double").alias("_x"))
        .filter("_x IS NOT NULL")
        .groupBy(*by, "_x")
        .agg(F.count(F.lit(1)).alias("_c"))
    )
    n, s1 = F.sum("_c"), F.sum(F.col("_c") * F.col("_x"))
    moments = merged.groupBy(*by).agg(
        n.alias("_n"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi"), (s1 / n).alias("_mean")
    )
    spread = attach(merged, moments, by).groupBy(*by, "_n", "_lo", "_hi").agg(
        F.sum(F.col("_c") * (F.col("_x") - F.col("_mean")) * (F.col("_x") - F.col("_mean"))).alias("_ss")
    )
    scott = F.sqrt(F.try_divide(F.col("_ss"), F.col("_n") - 1)) * F.pow(F.col("_n").cast("double"), F.lit(-0.2))
    shape = spread.select(
        *by, "_n", (F.lit(float(bandwidth)) if bandwidth else scott).alias("_h"), "_lo", "_hi"
    ).filter("_h > 0").select(
        *by, "_n", "_h", (F.col("_lo") - F.col("_h") * cut).alias("_from"),
        ((F.col("_hi") - F.col("_lo") + F.col("_h") * (2 * cut)) / (points - 1)).alias("_step"),
    )
    at = lambda i: F.col("_from") + F.col("_step") * i
    scaled = attach(merged, shape, by).select(
        *by, "_c", ((F.col("_x") - F.col("_from")) / F.col("_h")).alias("_u"), (F.col("_step") / F.col("_h")).alias("_du")
    )
    sums = kernel_sums(scaled, by, points).groupBy(*by, "point").agg(F.sum("_s").alias("_s"))
    scale = F.col("_n") * F.col("_h") * F.lit((2 * np.pi) ** 0.5)
    return attach(sums, shape, by).select(*by, "point", at(F.col("point")).alias("x"), (F.col("_s") / scale).alias("density"))


def binned_density(
    df: DataFrame, by: str | Sequence[str], value: str, points: int = 50, cut: float = 3.0, bandwidth: float | None = None, cells: int = 2001
) -> DataFrame:
    """``density`` from counts on a fine grid: every value is shared between the two of ``cells`` grid places beside it,
    in proportion to its nearness, and only these places meet the output points.

    Its cost over rows is one sum by group and cell, before any shuffle. With ``s`` the distance of two cells and ``h`` the
    bandwidth, the result is within 0.05 * (s / h)^2 / h of the exact density. Null values are left out, as are
    groups without spread; an empty table gives no rows.
    """
    by = names(by)
    rows = df.select(*by, F.col(value).cast("double").alias("_x")).filter("_x IS NOT NULL")
    scott = F.stddev_samp("_x") * F.pow(F.count(F.lit(1)).cast("double"), F.lit(-0.2))
    width = F.lit(float(bandwidth)) if bandwidth else scott
    shape = rows.groupBy(*by).agg(F.count(F.lit(1)).alias("_n"), width.alias("_h"), F.min("_x").alias("_lo"), F.max("_x").alias("_hi")).filter("_h > 0")
    shape = shape.select(*by, "_n", "_h", (F.col("_lo") - F.col("_h") * cut).alias("_from"), (F.col("_hi") - F.col("_lo") + F.col("_h") * (2 * cut)).alias("_span"))
    place = (F.col("_x") - F.col("_from")) / F.col("_span") * (cells - 1)
    placed = attach(rows, shape, by).withColumn("_at", place).withColumn("_cell", F.least(F.floor("_at"), F.lit(cells - 2)).cast("int"))
    group = [*by, "_n", "_h", "_from", "_span"]
    right = F.col("_at") - F.col("_cell")
    shared = placed.groupBy(*group, "_cell").agg(F.sum(1 - right).alias("_l"), F.sum(right).alias("_r"))
    sides = F.array(F.struct(F.col("_cell").alias("c"), F.col("_l").alias("w")), F.struct((F.col("_cell") + 1).alias("c"), F.col("_r").alias("w")))
    weights = shared.select(*group, F.explode(sides).alias("_s")).groupBy(*group, F.col("_s.c").alias("_cell")).agg(F.sum("_s.w").alias("_w"))
    met = weights.withColumn("point", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    x = F.col("_from") + F.col("_span") * F.col("point") / (points - 1)
    u = (F.col("_cell") / (cells - 1) - F.col("point") / (points - 1)) * F.col("_span") / F.col("_h")
    sums = met.groupBy(*group, "point").agg(F.sum(F.col("_w") * F.exp(-u * u / 2)).alias("_s"))
    return sums.select(*by, "point", x.alias("x"), (F.col("_s") / (F.col("_n") * F.col("_h") * F.lit((2 * np.pi) ** 0.5))).alias("density"))


def kernel_sums(scaled: DataFrame, by: Sequence[str], points: int) -> DataFrame:
    """(by…, point, _s): partial sums of ``_c``·exp(-(u - du·point)²/2) per batch of rows."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for key, rows in batch.groupby(by, sort=False):
                u, step = rows["_u"].to_numpy(), rows["_du"].iloc[0]
                kernels = np.exp(-0.5 * (u[:, None] - step * np.arange(points)) ** 2)
                out = pd.DataFrame(dict(zip(by, key if isinstance(key, tuple) else (key,))), index=range(points))
                yield out.assign(point=np.arange(points, dtype="int32"), _s=rows["_c"].to_numpy() @ kernels)

    fields = T.StructType([scaled.schema[c] for c in by])
    schema = fields.add("point", T.IntegerType()).add("_s", T.DoubleType())
    return scaled.mapInPandas(partial, schema)
