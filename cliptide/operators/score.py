"""Scoring clips with supplied models, combining models, ranking classes."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.ml.functions import predict_batch_udf
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cliptide.functions import arrays, transforms
from cliptide.operators.exact import exact_median, settled, small_table
from cliptide.operators.lookup import nearest_reference

MAX_CLASSES = 1000


def embed(df: DataFrame, loader: Callable, apply: Callable, samples: str = "samples", name: str = "embedding") -> DataFrame:
    """One row per (clip, chunk, frame): ``apply(model, batch)`` gives [frames, d] per chunk.

    Drop unlabelled clips before this step: no filter passes through it.
    """
    model = transforms.predictor(apply, loader, "array<array<float>>")
    others = [c for c in df.columns if c != samples]
    return df.select(*others, F.posexplode(model(samples)).alias("frame", name))


def frame_scores(df: DataFrame, loader: Callable, apply: Callable, samples: str = "samples") -> DataFrame:
    """Class scores per frame as an array: same contract as ``embed``."""
    return embed(df, loader, apply, samples, "scores")


def score_sequences(df: DataFrame, make_predict: Callable, shape: Sequence[int], frames: str = "frames", name: str = "score", batch_size: int = 256) -> DataFrame:
    """Score fixed-length sequences. ``make_predict`` loads the stored weights, once per worker,
    and returns a function from [batch, *shape] to one score per row."""
    predict = predict_batch_udf(
        make_predict, return_type=T.DoubleType(), batch_size=batch_size, input_tensor_shapes=[list(shape)]
    )
    flat = F.flatten(F.col(frames)).cast("array<float>")
    return df.withColumn(name, predict(flat))


def class_means(df: DataFrame, clip: Sequence[str], class_idx: str = "class_idx", score: str = "score") -> DataFrame:
    """Mean score over frames per clip and class (long rows; combined map-side)."""
    return df.groupBy(*clip, class_idx).agg(F.avg(score).alias(score))


def exploded_scores(df: DataFrame, scores: str = "scores") -> DataFrame:
    others = [c for c in df.columns if c != scores]
    return df.select(*others, F.posexplode(scores).alias("class_idx", "score"))


def named_scores(df: DataFrame, vocabulary: DataFrame, clip: Sequence[str], classes: dict[str, str], score: str = "score") -> DataFrame:
    """Mean score of each named class, one column per class: ``classes`` maps display name →
    column name. Only the named vocabulary rows are joined; they filter the frame scores before
    anything is shuffled. Means of ``class_means`` may be given too."""
    wanted = vocabulary.filter(F.col("display_name").isin(*classes)).select(
        F.col("index").alias("class_idx"), "display_name"
    )
    picked = df.join(small_table(wanted), "class_idx")
    return picked.groupBy(*clip).agg(
        *[F.avg(F.when(F.col("display_name") == shown, F.col(score))).alias(column) for shown, column in classes.items()]
    )


def class_indices(vocabulary: DataFrame, wanted: Sequence[str]) -> dict[str, int]:
    """Position of each wanted class name in the score arrays; the first one counts."""
    rows = (
        vocabulary.filter(F.col("display_name").isin(*wanted))
        .groupBy("display_name")
        .agg(F.min("index").alias("index"))
        .take(len(wanted))
    )
    found = {r["display_name"]: r["index"] for r in rows}
    missing = set(wanted) - set(found)
    if missing:
        raise ValueError(f"not in the vocabulary: {sorted(missing)}")
    return found


def combined_score(*scores: Column) -> Column:
    total = scores[0]
    for other in scores[1:]:
        total = total + other
    return total


def top_classes(df: DataFrame, clip: Sequence[str], k: int = 5, class_idx: str = "class_idx", score: str = "score") -> DataFrame:
    """The ``k`` best classes per clip, ties by class index. Input has one row per (clip, class)."""
    window = Window.partitionBy(*clip).orderBy(F.col(score).desc(), F.col(class_idx))
    return df.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k)


def expected_in_top(top: DataFrame, expected: DataFrame, clip: Sequence[str], class_idx: str = "class_idx") -> DataFrame:
    """Every expected (clip, class) with ``hit`` = it is among the clip's top classes."""
    keys = [*clip, class_idx]
    hits = top.select(*keys, F.lit(1).alias("hit"))
    return expected.join(hits, keys, "left").withColumn("hit", F.coalesce("hit", F.lit(0)))


def hit_rate(checked: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return checked.groupBy(*by).agg(
        F.count(F.lit(1)).alias("clips"), F.sum(F.col("hit").cast("bigint")).alias("hits"), F.avg("hit").alias("hit_rate")
    )


def by_model(df: DataFrame, models: Sequence[str], name: str = "score") -> DataFrame:
    """Rows × models: one row per model from one score column per model, without a join."""
    cells = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias(name)) for m in models])
    others = [c for c in df.columns if c not in models]
    return df.select(*others, F.inline(cells))


def thresholded_mean(scores: Sequence[Column], threshold: float = 0.5) -> Column:
    """Mean over models of the scores above the threshold, rounded half to even."""
    total = F.lit(0.0)
    for score in scores:
        total = total + F.when(score > F.lit(threshold), score).otherwise(F.lit(0.0))
    return F.bround(total / F.lit(float(len(scores)))).cast("int")


def posterior_weighted(models: Sequence[Column], truth: Column) -> Column:
    """Class chosen by weighting each model with its probability of the *true* class. It reads
    the truth, so it bounds what an ensemble could reach; it is not a predictor."""
    likelihood = [F.get(m, truth) for m in models]
    total = combined_score(*likelihood)
    weights = [F.try_divide(one, total) for one in likelihood]
    merged = None
    for model, weight in zip(models, weights):
        part = arrays.scaled(model, weight)
        merged = part if merged is None else F.zip_with(merged, part, lambda a, b: a + b)
    return arrays.argmax(merged)


def nearest_median(df: DataFrame, label: str = "label", score: str = "score", name: str = "nearest") -> DataFrame:
    """Each score takes the label whose median is closer; the smaller label wins a tie.

    The medians of a few classes become constants of the plan; beyond ``MAX_CLASSES`` labels a score finds
    its neighbours among the sorted medians.
    """
    each = exact_median(df.filter(F.col(label).isNotNull()), label, score, "_m")
    medians = each.take(MAX_CLASSES + 1)
    if len(medians) > MAX_CLASSES:
        return nearest_reference(df, settled(each, "medians"), score, label, "_m", name)
    kind = df.schema[label].dataType
    nearest = F.least(
        *[F.struct(F.abs(F.lit(r["_m"]) - F.col(score)).alias("d"), F.lit(r[label]).cast(kind).alias("l")) for r in medians]
        or [F.struct(F.lit(None).alias("d"), F.lit(None).cast(kind).alias("l"))] * 2
    ) if len(medians) != 1 else F.struct(F.lit(medians[0][label]).cast(kind).alias("l"))
    return df.withColumn(name, nearest["l"])


