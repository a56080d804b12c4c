"""A linear map with a matrix of any size: both sides are cut into tiles that meet on the tile index."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Inputs and outputs of a tile.
TILE = 512


def tiled_map(df: DataFrame, weights: DataFrame, by: Sequence[str], idx: str, value: str, name: str = "value", tile: int = TILE) -> DataFrame:
    """(by…, out_idx, name): Σ value·w over the ``weights`` (in_idx, out_idx, w) that meet the rows of ``df``.

    An output is there if a cell of ``weights`` meets one of its row's inputs; leave cells out that
    are 0. Values must be finite; a null one counts as absent. Neither side is broadcast. The rows are dealt to as many slices per output tile as keep
    all tasks busy; a task reads, for one output tile and one slice, each input tile's weights and then the
    rows, and multiplies batches of rows with that one matrix. Partial sums are combined in the task before
    they are shuffled.
    """
    spark, by = df.sparkSession, list(by)
    top = weights.agg(F.max("out_idx")).first()[0]
    out_tiles = 1 if top is None else int(top) // tile + 1
    slices = max(1, -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // out_tiles))

    key = F.struct(*by)
    cells = df.groupBy(*by, F.col(idx).cast("long").alias("_in")).agg(F.sum(F.col(value).cast("double")).alias("_v")).filter("_in IS NOT NULL AND _v IS NOT NULL")
    pair = lambda at, v: F.collect_list(F.struct((at % tile).cast("int").alias("at"), v.alias("v")))
    rows = cells.groupBy(*by, F.floor(F.col("_in") / tile).alias("in_tile")).agg(pair(F.col("_in"), F.col("_v")).alias("cells"))
    rows = rows.select(
        F.explode(F.sequence(F.lit(0), F.lit(out_tiles - 1))).alias("out_tile"), F.pmod(F.xxhash64(key), F.lit(slices)).cast("int").alias("slice"), "in_tile",
        F.lit(1).alias("kind"), F.lit(0).alias("line"), key.alias("row"), "cells",
    )
    lines = weights.filter("w IS NOT NULL").groupBy(F.col("in_idx").cast("long").alias("_in"), F.floor(F.col("out_idx") / tile).cast("int").alias("out_tile")).agg(
        pair(F.col("out_idx").cast("long"), F.col("w").cast("double")).alias("cells")
    )
    lines = lines.select(
        "out_tile", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), F.floor(F.col("_in") / tile).alias("in_tile"),
        F.lit(0).alias("kind"), (F.col("_in") % tile).cast("int").alias("line"), F.lit(None).cast(rows.schema["row"].dataType).alias("row"), "cells",
    )
    met = lines.unionByName(rows).repartition("out_tile", "slice").sortWithinPartitions("out_tile", "slice", "in_tile", "kind")
    schema = T.StructType([T.StructField("row", rows.schema["row"].dataType), T.StructField("out_tile", T.IntegerType()), T.StructField("values", T.ArrayType(T.DoubleType()))])
    partial = met.mapInArrow(_products(tile), schema)
    spread = partial.select("row", "out_tile", F.posexplode("values").alias("_at", "_v")).filter("_v IS NOT NULL")
    spread = spread.select(*[F.col("row")[c].alias(c) for c in by], (F.col("out_tile") * tile + F.col("_at")).cast("int").alias("out_idx"), "_v")
    return spread.groupBy(*by, "out_idx").agg(F.sum("_v").alias(name))


def _products(tile: int):
    """Arrow batches of (out_tile, slice, in_tile, kind, line, row, cells) in this order to partial products."""

    def run(batches):
        import pyarrow as pa

        now = weights = there = None
        for batch in batches:
            place = np.stack([batch.column(c).to_numpy() for c in ("out_tile", "slice", "in_tile", "kind")], axis=1)
            turns = np.flatnonzero(np.any(place[1:] != place[:-1], axis=1)) + 1
            for start, stop in zip([0, *turns], [*turns, len(place)]):
                if start == stop:
                    continue
                spot, kind = tuple(place[start][:3]), place[start][3]
                if spot != now:
                    now, weights, there = spot, np.zeros((tile, tile)), None
                part = batch.slice(start, stop - start)
                lists = part.column("cells")
                which = np.repeat(np.arange(stop - start), np.asarray(lists.value_lengths()))
                flat = lists.flatten()
                at, v = flat.field("at").to_numpy(), flat.field("v").to_numpy(zero_copy_only=False)
                if kind == 0:
                    np.add.at(weights, (part.column("line").to_numpy()[which], at), v)
                    there = None
                    continue
                if there is None:
                    there = (weights != 0).astype(np.float32)
                for first in range(0, stop - start, 1024):
                    n = min(1024, stop - start - first)
                    some = (which >= first) & (which < first + n)
                    dense, held = np.zeros((n, tile)), np.zeros((n, tile), np.float32)
                    dense[which[some] - first, at[some]] = v[some]
                    held[which[some] - first, at[some]] = 1
                    product, seen = dense @ weights, (held @ there) > 0
                    full = np.flatnonzero(seen.any(axis=1))
                    if not len(full):
                        continue
                    values = pa.array(product[full].ravel(), mask=~seen[full].ravel())
                    columns = [
                        part.column("row").slice(first, n).take(pa.array(full)), pa.array(np.full(len(full), spot[0]), pa.int32()),
                        pa.ListArray.from_arrays(pa.array(np.arange(0, len(full) * tile + 1, tile), pa.int32()), values),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "out_tile", "values"])

    return run


def weight_cells(spark, matrix: np.ndarray) -> DataFrame:
    """(in_idx, out_idx, w) of the cells of a constant matrix that are not 0."""
    import pyarrow as pa

    rows, cols = np.nonzero(matrix)
    return spark.createDataFrame(pa.table({"in_idx": rows.astype(np.int32), "out_idx": cols.astype(np.int32), "w": matrix[rows, cols].astype(float)}))
