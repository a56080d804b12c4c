"""Schemas and scans of annotation tables, manifests and the class vocabulary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# File layouts.
ANNOTATIONS = "filename string, id string, tv string, problems string"
ACTIVITIES = "audio_file string, activity string"
VOCABULARY = "index int, mid string, display_name string"
MANIFEST = "filename string, tv int, participant_id string"
SPLITS = ("train", "val", "test")


def read_csv(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Header CSV with a given schema; a file whose header disagrees with it is refused."""
    return (
        spark.read.schema(schema)
        .option("header", True)
        .option("enforceSchema", False)
        .option("quote", '"')
        .option("escape", '"')
        .csv(path)
    )


def read_annotations(spark: SparkSession, path: str, columns: Sequence[str]) -> DataFrame:
    """Annotation CSV: ``columns`` in file order, read as text (values are cleaned later)."""
    return read_csv(spark, path, ", ".join(f"`{c}` string" for c in columns))


def read_vocabulary(spark: SparkSession, path: str) -> DataFrame:
    return read_csv(spark, path, VOCABULARY)


def split_rows(manifest: DataFrame, split: str) -> DataFrame:
    """One split of a manifest table; a partition filter when it is partitioned by split."""
    return manifest.filter(F.col("split") == split)


def read_splits(spark: SparkSession, folder: str, schema: str = MANIFEST, required: bool = False) -> dict[str, DataFrame | None]:
    """``train.csv``, ``val.csv``, ``test.csv`` below a folder; an absent one is None, or an
    error when ``required``."""
    found: dict[str, DataFrame | None] = {}
    for split in SPLITS:
        try:
            found[split] = read_csv(spark, f"{folder}/{split}.csv", schema)
        except AnalysisException as error:
            if required or error.getCondition() != "PATH_NOT_FOUND":
                raise
            found[split] = None
    return found


def fold_rows(spark: SparkSession, path: str, fold_1: int, fold_2: int) -> DataFrame:
    """Training rows of a fold pair from a table partitioned by (fold_1, fold_2): only that
    directory is listed and read."""
    return spark.read.parquet(path).filter((F.col("fold_1") == fold_1) & (F.col("fold_2") == fold_2))


def read_fold_csv(spark: SparkSession, folder: str, fold_1: int, fold_2: int, schema: str = MANIFEST) -> DataFrame:
    return read_csv(spark, f"{folder}/train_fold_{fold_1}_{fold_2}.csv", schema)
