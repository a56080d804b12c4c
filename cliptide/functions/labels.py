"""Column expressions for annotation values, labels and file names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whitespace that counts as blank; slugs of the recording name whose first bit
# marks an interaction and whose second bit marks television.
BLANKS = " \t\n\r\f\x0b"
INTERACTION_SLUGS = ("100", "101", "110", "111")
TV_SLUGS = ("010", "011", "110", "111")


def clean_int(value: Column) -> Column:
    """Blank or NULL becomes 0; anything else must be a whole number, or the query fails."""
    bare = F.btrim(value.cast("string"), F.lit(BLANKS))
    filled = F.when(bare.isNull() | (bare == ""), F.lit("0")).otherwise(bare)
    return F.coalesce(
        filled.try_cast("int"),
        F.raise_error(F.concat(F.lit("not a whole number: "), filled)).cast("int"),
    )


def binary_target(value: Column, positive: str) -> Column:
    return F.when(value == positive, 1).otherwise(0)


def not_in(value: Column, excluded: list[str]) -> Column:
    """Exclusion that keeps rows with a missing value."""
    return value.isNull() | ~value.isin(excluded)


def base_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def stem(path: Column, first_dot: bool = False) -> Column:
    """File name without extension: cut at the last dot, or at the first one."""
    name = base_name(path)
    if first_dot:
        return F.split_part(name, F.lit("."), F.lit(1))
    return F.regexp_replace(name, r"(?<=[^.])\.[^.]*$", "")


def feature_path(folder: str | Column, name: Column, extension: str = ".npy") -> Column:
    folder = F.lit(folder) if isinstance(folder, str) else folder
    return F.concat(F.concat_ws("/", folder, name), F.lit(extension))


def slug_interaction(name: Column) -> Column:
    return F.split_part(name, F.lit("-"), F.lit(1)).isin(*INTERACTION_SLUGS).cast("int")


def slug_tv(name: Column) -> Column:
    return F.split_part(name, F.lit("-"), F.lit(1)).isin(*TV_SLUGS).cast("int")


def first_char_label(path: Column) -> Column:
    return F.substring(base_name(path), 1, 1)


def name_facts(name: Column) -> list[Column]:
    """``class-microphone-speaker-category.ext`` as four columns; speaker ``0`` means none."""
    parts = F.split(name, "-")
    speaker = parts[2]
    return [
        parts[0].cast("int").alias("class_label"),
        parts[1].alias("microphone"),
        F.when(speaker == "0", "NA").otherwise(speaker).alias("speaker"),
        F.split_part(parts[3], F.lit("."), F.lit(1)).alias("category"),
    ]


def above(score: Column, threshold: float = 0.5) -> Column:
    return (score > F.lit(float(threshold))).cast("int")


def below(score: Column, threshold: float = 0.5) -> Column:
    return (score < F.lit(float(threshold))).cast("int")
