"""Seeded sampling, balancing, splits and folds.

Every draw is "lowest md5 of seed:key first" within its stratum.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators.exact import attach, hash_key, hash_parts, hash_rank, lowest_by_hash, names, row_index


def shuffled(df: DataFrame, key: str | Sequence[str], seed: int | str = 42) -> DataFrame:
    """The table in seeded random order (a distributed range sort)."""
    key = names(key)
    return df.withColumn("_h", hash_key(seed, *key)).orderBy("_h", *key).drop("_h")


def balance_binary(df: DataFrame, key="filename", label: str = "tv", seed=42) -> DataFrame:
    """Shrink the larger of classes 0 and 1 to the size of the other; an absent class counts
    as empty, so then nothing is left."""

    def quota(totals: DataFrame) -> DataFrame:
        size = lambda c: F.coalesce(F.max(F.when(F.col(label) == c, F.col("total"))), F.lit(0))
        least = totals.agg(F.least(size(0), size(1)).alias("q"))
        return totals.withColumn("quota", least.scalar())

    return lowest_by_hash(df.filter(F.col(label).isin(0, 1)), key, label, quota, seed)


def balance_classes(df: DataFrame, key="filename", label="tv", seed=42, within: Sequence[str] = ()) -> DataFrame:
    """Shrink every class to the smallest one, separately inside each ``within`` group."""
    within = list(within)

    def quota(totals: DataFrame) -> DataFrame:
        if not within:
            return totals.withColumn("quota", totals.agg(F.min("total")).scalar())
        return totals.join(totals.groupBy(*within).agg(F.min("total").alias("quota")), within)

    return lowest_by_hash(df, key, [*within, label], quota, seed)


def shrink_to_quota(
    df: DataFrame,
    key: str = "filename",
    label: str = "tv",
    activity: str = "activity",
    shrinkable: Sequence[str] = ("absence", "working"),
    seed=42,
) -> DataFrame:
    """Only the shrinkable negative activities lose rows, until negatives equal positives.

    Fails when the other negatives alone outnumber the positives, or when the shrinkable ones
    are too few, as sampling without replacement would.
    """
    stratum = (
        F.when(F.col(label) == 1, "positive")
        .when(F.col(activity).isin(*shrinkable), "shrink")
        .otherwise("other")
    )

    def quota(totals: DataFrame) -> DataFrame:
        size = lambda s: F.coalesce(F.max(F.when(F.col("_stratum") == s, F.col("total"))), F.lit(0))
        room = size("positive") - size("other")
        checked = F.when(room < 0, F.raise_error(F.lit("negatives outnumber positives")).cast("bigint")).when(
            room > size("shrink"), F.raise_error(F.lit("too few rows to draw from")).cast("bigint")
        ).otherwise(room)
        target = totals.agg(checked.alias("q")).scalar()
        return totals.withColumn("quota", F.when(F.col("_stratum") == "shrink", target).otherwise(F.col("total")))

    tagged = df.withColumn("_stratum", stratum)
    return lowest_by_hash(tagged, key, "_stratum", quota, seed).drop("_stratum")


def merge_balanced(
    df: DataFrame,
    key: str = "filename",
    dataset: str = "dataset",
    label: str = "tv",
    seed=42,
    stratified: bool = False,
) -> DataFrame:
    """Balance classes inside each dataset, then draw every dataset down to the smallest.

    The second draw ignores the class unless ``stratified``; then each class gives the same
    share (exact when the smallest dataset divides evenly).
    """
    within = balance_classes(df, key, label, seed, [dataset])
    strata = [dataset, label] if stratified else [dataset]

    def quota(totals: DataFrame) -> DataFrame:
        return totals.withColumn("quota", totals.agg(F.min("total")).scalar())

    return lowest_by_hash(within, key, strata, quota, f"{seed}-between")


def _three_way(df: DataFrame, key, by, seed, test_size: float) -> DataFrame:
    """Part 0 is train; the held-out ⌈test_size·n⌉ go half (floor) to val, half (ceil) to test."""

    def sizes(totals: DataFrame) -> DataFrame:
        held = F.ceil(F.round(F.col("total") * F.lit(test_size), 9))
        test = F.ceil(held / 2)
        return totals.withColumn(
            "cuts", F.array((F.col("total") - held).cast("bigint"), (F.col("total") - test).cast("bigint"))
        )

    parts = hash_parts(df, key, by, sizes, 2, seed, "_part")
    split = F.when(F.col("_part") == 0, "train").when(F.col("_part") == 1, "val").otherwise("test")
    return parts.withColumn("split", split).drop("_part")


def group_split(df: DataFrame, group: str = "participant_id", seed=42, test_size: float = 0.3) -> DataFrame:
    """70/15/15 split of whole participants: no participant is in two splits."""
    groups = df.select(group).filter(F.col(group).isNotNull()).distinct()
    return attach(df, _three_way(groups, group, [], seed, test_size), [group])


def stratified_split(df: DataFrame, key="filename", label="tv", seed=42, test_size: float = 0.3) -> DataFrame:
    return _three_way(df, key, label, seed, test_size)


def block_fold(idx: Column, block: int = 20, folds: int = 4) -> Column:
    """Fold of a row position: runs of ``block`` rows, dealt round robin."""
    return F.pmod(F.floor(idx / block), F.lit(folds)).cast("int")


def shuffled_folds(df: DataFrame, key, folds: int = 4, seed=42) -> DataFrame:
    """Seeded k-fold: fold sizes differ by at most one."""
    ranked = hash_rank(df, key, seed=seed, name="_rank")
    return ranked.withColumn("fold", F.pmod(F.col("_rank") - 1, F.lit(folds)).cast("int")).drop("_rank")


def equal_folds(df: DataFrame, key, folds: int = 5, seed=42) -> DataFrame:
    """Folds of exactly ⌊n/folds⌋ rows in hash order; the remainder is dropped."""

    def sizes(totals: DataFrame) -> DataFrame:
        each = F.floor(F.col("total") / folds)
        return totals.withColumn("cuts", F.array(*[(each * i).cast("bigint") for i in range(1, folds + 1)]))

    parts = hash_parts(df, key, [], sizes, folds, seed, "fold")
    return parts.filter(F.col("fold") < folds)


def nested_roles(df: DataFrame, test: int, val: int, fold: str = "fold") -> DataFrame:
    """Role per row: ``test`` is a fold number, ``val`` counts among the folds that remain."""
    held = val if val < test else val + 1
    role = F.when(F.col(fold) == test, "test").when(F.col(fold) == held, "val").otherwise("train")
    return df.withColumn("role", role)


def fold_roles(df: DataFrame, folds: int, fold: str = "fold") -> DataFrame:
    """Each row once per held-out fold, as ``val`` in its own fold and ``train`` in the others."""
    held = F.explode(F.sequence(F.lit(0), F.lit(folds - 1)))
    role = F.when(F.col("held_out") == F.col(fold), "val").otherwise("train")
    return df.withColumn("held_out", held).withColumn("role", role)


def train_rows(df: DataFrame, held_out: int, fold: str = "fold") -> DataFrame:
    return df.filter(F.col(fold) != held_out)


def held_out_rows(df: DataFrame, held_out: int, fold: str = "fold") -> DataFrame:
    return df.filter(F.col(fold) == held_out)


def batches(df: DataFrame, key, epoch: int, size: int = 32) -> DataFrame:
    """Mini-batch number of every row, reshuffled for each epoch."""
    ranked = hash_rank(df, key, seed=epoch, name="_rank")
    return ranked.withColumn("batch", F.floor((F.col("_rank") - 1) / size)).drop("_rank")


def sliding_balanced_fold(
    df: DataFrame,
    order: Sequence[str],
    label: str = "tv",
    fold: int = 1,
    step_ratio: float = 0.5,
) -> DataFrame:
    """The minority class plus a window of as many majority rows, ``fold - 1`` steps along.

    The step is ⌊step_ratio·minority⌋; a fold beyond the last becomes the last; a minority
    too small for one step is refused.
    """
    binary = df.filter(F.col(label).isin(0, 1))
    sizes = binary.agg(
        F.count_if(F.col(label) == 0).alias("n0"), F.count_if(F.col(label) == 1).alias("n1")
    )
    plan = (
        sizes.withColumn("major", F.when(F.col("n0") > F.col("n1"), 0).otherwise(1))
        .withColumn("small", F.least("n0", "n1"))
        .withColumn("step", F.floor(F.col("small") * F.lit(step_ratio)))
        .withColumn("step", F.when(F.col("step") > 0, F.col("step")).otherwise(
            F.raise_error(F.lit("the smaller class is too small for a step")).cast("bigint")))
        .withColumn("last", F.floor((F.abs(F.col("n0") - F.col("n1"))) / F.col("step")) + 1)
        .withColumn("start", (F.least(F.lit(fold).cast("bigint"), F.col("last")) - 1) * F.col("step"))
        .withColumn("first", F.when(F.col("major") == 1, F.col("n0")).otherwise(0))
        .select(F.struct("major", "small", "start", "first"))
    )
    indexed = row_index(binary, [label, *order], "_idx").withColumn("_plan", plan.scalar())
    offset = F.col("_idx") - F.col("_plan.first") - F.col("_plan.start")
    chosen = (F.col(label) != F.col("_plan.major")) | ((offset >= 0) & (offset < F.col("_plan.small")))
    return indexed.filter(chosen).drop("_idx", "_plan")


