"""Nearest of many reference values by range lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators.exact import SMALL_ROWS, row_index

#: References in a range, while their boundaries are few.
RANGE = 1000


def last_at_most(values: Column, x: Column, limit: int, get=lambda cell: cell) -> Column:
    """0-based place of the last of the ascending ``values`` that is at most ``x``, -1 if none is: a binary
    search in as many steps as ``limit`` (the largest size) has bits."""
    steps = F.array(*[F.lit(1 << i) for i in reversed(range(max(1, limit.bit_length())))])
    size = F.size(values)
    onward = lambda at, step: F.when((at + step < size) & (get(F.get(values, F.least(at + step, size - 1))) <= x), at + step).otherwise(at)
    return F.aggregate(steps, F.lit(-1), onward)


def nearest_reference(df: DataFrame, references: DataFrame, score: str, label: str, value: str, name: str = "nearest", size: int = RANGE) -> DataFrame:
    """``df`` with the ``label`` of the reference whose ``value`` is nearest to ``score``; of equally near ones
    the smaller label wins. Near is meant exactly: a score so far away that all distances round to the
    same number still takes the outermost reference.

    The sorted references are cut into ranges of ``size`` (more, so that there are at most ``SMALL_ROWS``
    ranges). A score finds its range by binary search over the ranges' first values, meets
    the references of that range by an equi-join, and finds its two neighbours among them by binary search;
    a range also holds the first reference of the next one. References without a value or a label are left
    out; a null or NaN score, or no reference at all, gives null.
    """
    usable = references.select(F.col(value).cast("double").alias("_m"), F.col(label).alias("_l")).filter("_m IS NOT NULL AND _l IS NOT NULL AND NOT isnan(_m)")
    placed = row_index(usable.groupBy("_m").agg(F.min("_l").alias("_l")), "_m", "_i")
    total = placed.count()
    width = max(size, -(-total // SMALL_ROWS))
    bounds = placed.filter(F.col("_i") % width == 0).agg(F.array_sort(F.collect_list("_m")).alias("_b"))
    own = F.floor(F.col("_i") / width)
    homes = F.when((F.col("_i") % width == 0) & (own > 0), F.array(own, own - 1)).otherwise(F.array(own))
    ranges = placed.withColumn("_range", F.explode(homes)).groupBy("_range").agg(F.array_sort(F.collect_list(F.struct("_m", "_l"))).alias("_refs"))

    x = F.col("_x")
    known = df.withColumn("_x", F.nanvl(F.col(score).cast("double"), F.lit(None).cast("double"))).withColumn("_bounds", bounds.scalar())
    at = F.greatest(last_at_most(F.col("_bounds"), x, -(-total // width) + 1), F.lit(0))
    joined = known.withColumn("_range", F.when(x.isNotNull(), at).cast("long")).drop("_bounds").join(ranges, "_range", "left")
    below = last_at_most(F.col("_refs"), x, width + 1, lambda r: r["_m"])
    side = lambda r: F.when(r.isNotNull(), F.struct(F.abs(r["_m"] - x).alias("d"), r["_l"].alias("l")))
    found = joined.withColumn("_at", below)
    best = F.least(side(F.when(F.col("_at") >= 0, F.get("_refs", F.greatest("_at", F.lit(0))))), side(F.get("_refs", F.col("_at") + 1)))
    return found.withColumn(name, best["l"]).select(*df.columns, name)
