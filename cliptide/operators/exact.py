"""Exact ranks, cuts, scans and medians that never put a large group into one task.

The recurring idea: split an ordered group into many buckets whose order is known, count
per bucket, accumulate the small table of counts, and do the fine ordering inside single
buckets only.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.session import scratch_path

SMALL_ROWS = 10_000


def names(cols: str | Sequence[str]) -> list[str]:
    return [cols] if isinstance(cols, str) else list(cols)


def small_table(df: DataFrame, max_rows: int = SMALL_ROWS) -> DataFrame:
    """Evaluate ``df`` once; if it has at most ``max_rows`` rows, return them as a broadcast.

    Larger tables come back unchanged, to be joined by shuffle. At most ``max_rows + 1``
    rows reach the driver.
    """
    rows = df.take(max_rows + 1)
    if len(rows) > max_rows:
        return df
    return F.broadcast(df.sparkSession.createDataFrame(rows, df.schema))


def attach(df: DataFrame, stats: DataFrame, on: Sequence[str], few: bool = True) -> DataFrame:
    """Add per-group columns. Without keys, ``stats`` is one row and becomes a scalar."""
    if not on:
        cols = stats.columns
        one = stats.select(F.struct(*cols).alias("_one"))
        return (
            df.withColumn("_one", one.scalar())
            .select(*df.columns, *[F.col("_one")[c].alias(c) for c in cols])
        )
    return df.join(small_table(stats) if few else stats, list(on))


def settled(df: DataFrame, name: str = "settled") -> DataFrame:
    """Write ``df`` below the shared folder and read it back.

    For a thin table that came out of a costly shuffle and is now read several times: later
    passes prune its columns, and a lost executor does not bring the shuffle back.
    """
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def hash_key(seed: int | str, *key: str) -> Column:
    """The order used by every seeded draw: md5 of ``seed:key``."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[F.col(k).cast("string") for k in key]))


def _running_before(by: Sequence[str], bucket: str, count: str) -> Column:
    # The table it runs over has one row per (group, bucket); buckets are bounded.
    window = (
        Window.partitionBy(*(by or [F.lit(0)]))
        .orderBy(bucket)
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    return F.coalesce(F.sum(count).over(window), F.lit(0))


def bucketed_rank(
    df: DataFrame,
    by: str | Sequence[str],
    bucket: Column,
    order: Sequence[str],
    name: str = "rank",
) -> DataFrame:
    """1-based row number within ``by`` under ``order``.

    ``bucket`` must be monotone in ``order``. Rows shuffle on (by, bucket), so a group that
    holds most of the table is still ranked by many tasks. Rows with a NULL group are dropped.
    """
    by = names(by)
    rows = df.withColumn("_bucket", bucket)
    for column in by:
        rows = rows.filter(F.col(column).isNotNull())
    before = (
        rows.groupBy(*by, "_bucket")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", _running_before(by, "_bucket", "_n"))
        .drop("_n")
    )
    within = Window.partitionBy(*by, "_bucket").orderBy(*order)
    return (
        rows.join(before, [*by, "_bucket"])
        .withColumn(name, F.row_number().over(within) + F.col("_before"))
        .select(*df.columns, name)
    )


def hash_rank(
    df: DataFrame,
    key: str | Sequence[str],
    by: str | Sequence[str] = (),
    seed: int | str = 42,
    name: str = "rank",
    prefix: int = 4,
) -> DataFrame:
    """1-based position of every row in the seeded hash order, within ``by``.

    ``key`` identifies a row, so the hashes are spread evenly whatever the group sizes are.
    """
    key = names(key)
    hashed = df.withColumn("_h", hash_key(seed, *key))
    ranked = bucketed_rank(hashed, by, F.substring("_h", 1, prefix), ["_h", *key], name)
    return ranked.drop("_h")


def hash_parts(
    df: DataFrame,
    key: str | Sequence[str],
    by: str | Sequence[str],
    sizes: Callable[[DataFrame], DataFrame],
    n_cuts: int,
    seed: int | str = 42,
    name: str = "part",
    prefix: int = 4,
) -> DataFrame:
    """Cut each group at exact positions of its hash order, without shuffling whole rows.

    ``sizes`` maps the table ``(by…, total)`` to ``(by…, total, cuts)`` where ``cuts`` is an
    ascending array of ``n_cuts`` cumulative sizes. Part ``i`` of a row is the number of cuts it lies
    beyond. Three passes: counts per (group, bucket) and the one bucket that holds each cut,
    both over key columns only, then a map-side comparison with the cut values.
    """
    key, by = names(key), names(by)
    keyed = df.withColumn("_h", hash_key(seed, *key))
    slim = keyed.select(*by, *[k for k in key if k not in by], "_h").withColumn(
        "_bucket", F.substring("_h", 1, prefix)
    )
    counts = slim.groupBy(*by, "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    totals = counts.groupBy(*by).agg(F.sum("_n").alias("total"))
    plan = sizes(totals).select(*by, "total", "cuts")
    cumulative = counts.withColumn("_before", _running_before(by, "_bucket", "_n"))
    marks = F.filter(
        F.transform(
            "cuts",
            lambda at, i: F.struct(
                i.alias("cut"), F.col("_bucket").alias("bucket"), (at - F.col("_before")).alias("need")
            ),
        ),
        lambda m: (m["need"] > 0) & (m["need"] <= F.col("_n")),
    )
    summary = small_table(
        attach(cumulative, plan, by, few=False)
        .withColumn("_marks", marks)
        .groupBy(*by)
        .agg(
            F.first("total").alias("total"),
            F.first("cuts").alias("cuts"),
            F.flatten(F.collect_list(F.when(F.size("_marks") > 0, F.col("_marks")))).alias("_marks"),
        )
    )
    holding = summary.select(*by, F.explode("_marks").alias("_m")).select(
        *by, F.col("_m.bucket").alias("_bucket"), F.col("_m.cut").alias("_cut"), F.col("_m.need").alias("_need")
    )
    position = F.row_number().over(Window.partitionBy(*by, "_cut").orderBy("_h", *key))
    edge = F.struct("_h", *key)
    edges = (
        slim.join(holding, [*by, "_bucket"])
        .withColumn("_position", position)
        .filter("_position = _need")
        .groupBy(*by)
        .agg(F.map_from_entries(F.collect_list(F.struct("_cut", edge.alias("edge")))).alias("_edges"))
    )
    limits = summary.drop("_marks")
    if by:
        limits = limits.join(edges, by, "left")
    else:
        limits = limits.withColumn("_edges", edges.scalar())
    beyond = F.lit(0)
    for i in range(n_cuts):
        at = F.get("cuts", F.lit(i))
        past = F.when(at >= F.col("total"), 0).when(at <= 0, 1).when(edge > F.col("_edges")[i], 1)
        beyond = beyond + past.otherwise(0)
    return attach(keyed, limits, by).withColumn(name, beyond).select(*df.columns, name)


def lowest_by_hash(df, key, by, quota: Callable[[DataFrame], DataFrame], seed=42, prefix=4):
    """Keep the ``quota`` rows that come first in the hash order of each group.

    ``quota`` maps ``(by…, total)`` to a table with an added ``quota`` column.
    """

    def sizes(totals: DataFrame) -> DataFrame:
        return quota(totals).withColumn("cuts", F.array("quota"))

    return hash_parts(df, key, by, sizes, 1, seed, "_part", prefix).filter("_part = 0").drop("_part")


def row_index(df: DataFrame, order: str | Sequence[str], name: str = "idx") -> DataFrame:
    """0-based global position under ``order``, which must be a total order.

    One range shuffle on the whole order key. Each sorted partition is written with its number
    and local positions, so the counts and the positions cannot disagree after a lost executor.
    """
    order = names(order)
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    placed = settled(
        ordered.withColumn("_pid", F.spark_partition_id()).withColumn(
            "_local", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        ),
        "indexed",
    )
    before = (
        placed.groupBy("_pid")
        .agg(F.count(F.lit(1)).alias("_n"))
        .withColumn("_before", _running_before([], "_pid", "_n"))
        .select("_pid", "_before")
    )
    return (
        placed.join(F.broadcast(before), "_pid")  # one row per partition
        .withColumn(name, F.col("_local") + F.col("_before"))
        .select(*df.columns, name)
    )


def running(
    df: DataFrame,
    by: str | Sequence[str],
    pos: str,
    value: str,
    how: str = "sum",
    name: str = "running",
    block: int = 4096,
) -> DataFrame:
    """Running ``sum`` or ``max`` along ``pos``, in blocks, so that one long clip is shared
    between tasks: a scan inside each block plus the carry from the blocks before it."""
    by = names(by)
    agg = {"sum": F.sum, "max": F.max}[how]
    rows = df.withColumn("_block", F.floor(F.col(pos) / block))
    inner = Window.partitionBy(*by, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    outer = Window.partitionBy(*by).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    carry = (
        rows.groupBy(*by, "_block")
        .agg(agg(value).alias("_value"))
        .withColumn("_carry", agg("_value").over(outer))
        .drop("_value")
    )
    here, ahead = agg(value).over(inner), F.col("_carry")
    total = F.greatest(here, ahead) if how == "max" else here + F.coalesce(ahead, F.lit(0))
    return rows.join(carry, [*by, "_block"]).withColumn(name, total).select(*df.columns, name)


def exact_median(
    df: DataFrame,
    by: str | Sequence[str],
    value: str,
    name: str = "median",
    accuracy: int = 10_000,
    few: bool = True,
) -> DataFrame:
    """Exact median per group without holding a group's values in one buffer.

    An approximate percentile brackets the middle; exact counts say which side of the bracket
    the middle ranks fall on; only those rows, merged by value, are ordered. A bad bracket
    costs time, never the result.
    """
    by = names(by)
    slim = df.select(*by, F.col(value).cast("double").alias("_v")).filter("_v IS NOT NULL")
    gap = 2.0 / accuracy
    brackets = slim.groupBy(*by).agg(
        F.percentile_approx("_v", [0.5 - gap, 0.5 + gap], accuracy).alias("_b")
    )
    zoned = attach(slim, brackets, by, few).select(
        *by,
        "_v",
        F.when(F.col("_v") < F.col("_b")[0], 0).when(F.col("_v") <= F.col("_b")[1], 1).otherwise(2).alias("_zone"),
    )
    tally = (
        zoned.groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("_n"),
            F.count_if(F.col("_zone") == 0).alias("_n0"),
            F.count_if(F.col("_zone") <= 1).alias("_n1"),
        )
        .withColumn("_r1", F.floor((F.col("_n") + 1) / 2))
        .withColumn("_r2", F.floor(F.col("_n") / 2) + 1)
    )
    zone_of = lambda r: F.when(r <= F.col("_n0"), 0).when(r <= F.col("_n1"), 1).otherwise(2)
    start = F.when(F.col("_zone") == 0, 0).when(F.col("_zone") == 1, F.col("_n0")).otherwise(F.col("_n1"))
    upto = Window.partitionBy(*by, "_zone").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    middle = (
        attach(zoned, tally, by, few)
        .filter((F.col("_zone") == zone_of(F.col("_r1"))) | (F.col("_zone") == zone_of(F.col("_r2"))))
        .groupBy(*by, "_zone", "_v", "_n0", "_n1", "_r1", "_r2")
        .agg(F.count(F.lit(1)).alias("_c"))
        .withColumn("_to", F.sum("_c").over(upto) + start)
    )
    at = lambda r: F.max(F.when((F.col("_to") - F.col("_c") < F.col(r)) & (F.col(r) <= F.col("_to")), F.col("_v")))
    return middle.groupBy(*by).agg(((at("_r1") + at("_r2")) / 2).alias(name))
