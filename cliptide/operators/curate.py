"""Annotation curation: cleaning, coder agreement, de-duplication, label joins, profiles."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.functions import labels
from cliptide.operators.exact import names


def lower_columns(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lower() for c in df.columns])


def rename(df: DataFrame, mapping: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(mapping))


def clean_flags(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Blank-to-zero and strict integer cast, per column."""
    return df.withColumns({c: labels.clean_int(F.col(c)) for c in columns})


def without_problems(df: DataFrame, column: str = "problems") -> DataFrame:
    return df.filter(F.col(column) == 0)


def drop_activities(df: DataFrame, excluded: Sequence[str], column: str = "activity") -> DataFrame:
    return df.filter(labels.not_in(F.col(column), list(excluded)))


def label_slice(df: DataFrame, column: str, value: int = 1) -> DataFrame:
    return df.filter(F.col(column) == value)


def agreed(df: DataFrame, key: str | Sequence[str] = "filename", label: str = "tv") -> DataFrame:
    """All rows of the groups whose coders gave exactly one distinct label."""
    key = names(key)
    same = (
        df.groupBy(*key)
        .agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"))
        .filter("_lo = _hi")
        .select(*key)
    )
    return df.join(same, key, "left_semi")


def keep_first(df: DataFrame, key: str | Sequence[str], order: Sequence[str]) -> DataFrame:
    """First row of each key under ``order``. Every map task drops its own later duplicates
    before the shuffle, so a key that repeats endlessly costs one row per task."""
    window = Window.partitionBy(*names(key)).orderBy(*order)
    return df.withColumn("_rn", F.row_number().over(window)).filter("_rn = 1").drop("_rn")


def curated_labels(
    df: DataFrame,
    order: Sequence[str],
    key: str = "filename",
    label: str = "tv",
    keep: Sequence[str] = (),
) -> DataFrame:
    """Agreement and keep-first in one aggregation: a single shuffle, combined map-side.

    With one order column (a row number) and kept columns of fixed size, no sort is needed.
    """
    aggs = [F.min(label).alias("_lo"), F.max(label).alias("_hi")]
    if len(order) == 1:
        aggs += [F.min_by(c, order[0]).alias(c) for c in keep]
        kept = list(keep)
    elif keep:
        aggs.append(F.min_by(F.struct(*keep), F.struct(*order)).alias("_first"))
        kept = [F.col("_first")[c].alias(c) for c in keep]
    else:
        kept = []
    grouped = df.filter(F.col(key).isNotNull()).groupBy(key).agg(*aggs).filter("_lo = _hi")
    return grouped.select(key, F.col("_lo").alias(label), *kept)


def binary_activity(
    df: DataFrame, positive: str = "watching tv", column: str = "activity", target: str = "tv"
) -> DataFrame:
    return df.withColumn(target, labels.binary_target(F.col(column), positive))


def with_features(df: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    """Keep the annotated clips that have a feature file."""
    return df.join(files.select(key), key, "left_semi")


def missing_features(df: DataFrame, files: DataFrame, key: str = "filename") -> DataFrame:
    return df.join(files.select(key), key, "left_anti")


def labelled(clips: DataFrame, truth: DataFrame, key: str = "filename") -> DataFrame:
    """Clips with their label; unlabelled clips go no further. Place it below decoding."""
    return clips.join(truth, key)


def feature_lookup(truth: DataFrame, features: DataFrame, key: str = "filename") -> DataFrame:
    """Every labelled clip with its features; labels without features are dropped."""
    return truth.join(features, key)


def class_counts(df: DataFrame, label: str = "tv", by: Sequence[str] = ()) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("records"),
        F.count_if(F.col(label) > 0).alias("positive"),
        F.count_if(F.col(label) <= 0).alias("negative"),
    )


def dataset_profile(
    df: DataFrame,
    by: Sequence[str] = (),
    participant: str = "participant_id",
    label: str = "tv",
    approximate: bool = False,
) -> DataFrame:
    """Rows, distinct participants and positives.

    The exact form counts per participant first, so distinct values are merged map-side and
    spread over tasks; ``approximate`` uses a sketch instead.
    """
    by = list(by)
    positives = F.sum(F.col(label).cast("bigint"))
    if approximate:
        return df.groupBy(*by).agg(
            F.count(F.lit(1)).alias("records"),
            F.approx_count_distinct(participant).alias("participants"),
            positives.alias("positives"),
        )
    return (
        df.groupBy(*by, participant)
        .agg(F.count(F.lit(1)).alias("_n"), positives.alias("_p"))
        .groupBy(*by)
        .agg(
            F.sum("_n").alias("records"),
            F.count(participant).alias("participants"),
            F.sum("_p").alias("positives"),
        )
    )


def smallest_class(df: DataFrame, label: str = "tv") -> DataFrame:
    sizes = df.filter(F.col(label).isNotNull()).groupBy(label).agg(F.count(F.lit(1)).alias("_n"))
    return sizes.agg(F.min("_n").alias("min_class_size"))


def union_all(*parts: DataFrame) -> DataFrame:
    """Union by column name; a column that a part lacks is NULL there."""
    whole = parts[0]
    for part in parts[1:]:
        whole = whole.unionByName(part, allowMissingColumns=True)
    return whole


def difference(df: DataFrame, remove: DataFrame, key: str | Sequence[str]) -> DataFrame:
    return df.join(remove.select(*names(key)), names(key), "left_anti")


def subset_scores(df: DataFrame, score: str, flags: Sequence[str]) -> DataFrame:
    """Long ``(subset, score)`` rows, one per 0/1 column that is set; absent columns are skipped."""
    present = [c for c in flags if c in df.columns]
    tags: Column = F.array_compact(F.array(*[F.when(F.col(c) == 1, F.lit(c)) for c in present]))
    return df.select(F.explode(tags).alias("subset"), F.col(score).alias("score"))
