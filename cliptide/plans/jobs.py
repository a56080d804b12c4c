"""Whole jobs made of the operators."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.functions import labels
from cliptide.operators import curate, evaluate, sample, score, sequence, spectral
from cliptide.operators.exact import settled
from cliptide.sources import files as media


def curation(annotations: DataFrame, order: Sequence[str], seed=42) -> DataFrame:
    """Clean, agree, de-duplicate, drop problem clips, balance 1:1."""
    return sample.balance_binary(settled(curated(annotations, order), "curated"), "filename", "tv", seed)


def curated(annotations: DataFrame, order: Sequence[str]) -> DataFrame:
    """The curation without the balancing: (filename, tv, participant_id)."""
    clean = curate.clean_flags(curate.rename(curate.lower_columns(annotations), {"id": "participant_id"}), ["tv", "problems"])
    kept = curate.curated_labels(clean, order, keep=["participant_id", "problems"])
    return curate.without_problems(kept).drop("problems")


def curation_profile(annotations: DataFrame, order: Sequence[str], seed=42) -> DataFrame:
    """Class counts and participants of the balanced set, in one row per class."""
    return curate.dataset_profile(curation(annotations, order, seed), ["tv"])


def training_set(manifest: DataFrame, features: DataFrame, width: int, length: int = 31, seed=42) -> DataFrame:
    """Balanced union of datasets with padded sequences and labels."""
    merged = sample.merge_balanced(manifest, seed=seed)
    return sequence.pad_sequences(curate.feature_lookup(merged, features), width, length)


def clip_scores(
    clips: DataFrame, vocabulary: DataFrame, loader: Callable, apply: Callable, classes: dict[str, str],
    by: Sequence[str] = ("filename", "tv"), samples: str = "samples",
) -> DataFrame:
    """Labelled clips → frame scores → mean of each named class per clip.

    Join the labels before this step, so that clips without a label are never scored. The named
    classes are picked from the score arrays, so a frame adds a few numbers to one aggregation.
    """
    scored = score.frame_scores(clips.select(*by, samples), loader, apply, samples)
    index = score.class_indices(vocabulary, list(classes))
    picked = [F.avg(F.get("scores", F.lit(index[shown]))).alias(column) for shown, column in classes.items()]
    return scored.groupBy(*by).agg(*picked)


def score_corpus(
    listed: DataFrame, truth: DataFrame, vocabulary: DataFrame, loader: Callable, apply: Callable,
    classes: dict[str, str], rate: int = spectral.SAMPLE_RATE,
) -> DataFrame:
    """Listed (path, length) audio files → label join → decode → resample → ``clip_scores``.

    Only names and sizes meet the labels (filename, tv); the audio is read afterwards, by the
    task that decodes it, and is never shuffled.
    """
    named = listed.withColumn("filename", labels.base_name(F.col("path")))
    wanted = media.spread_by_bytes(curate.labelled(named, truth.select("filename", "tv")))
    decoded = media.good_records(media.decode_wav(wanted, keep=["filename", "tv"]))
    level = F.when(F.col("sr") == rate, F.col("samples").cast("array<double>")).otherwise(
        spectral.resample_array(F.col("samples"), F.col("sr"), rate)
    )
    return clip_scores(decoded.withColumn("samples", level), vocabulary, loader, apply, classes)


def fold_comparison(predictions: DataFrame, models: Sequence[str] | None = None) -> DataFrame:
    """(model, fold, y_true, y_pred) rows of all folds → metric × model table of fold means."""
    each = evaluate.binary_metrics(predictions, ["model", "fold"])
    return evaluate.comparison_table(evaluate.mean_over_folds(each, ["model"]), models=models)
