"""Ordered pieces of long groups of rows.

Rows are dealt by range over (key, order), so that a group of any size spreads over many tasks, and cut
into pieces: runs of rows of one key, at most ``ROWS`` of them. A piece that touches the end of an Arrow
batch may be continued by another one; ``whole`` says that it is not. What has to follow a group from its
first row to its last is passed along between such pieces only, one thin row for each.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import types as T

from cliptide.llm.common import slices
from cliptide.operators.exact import settled

ROWS = 4096


def _same(column) -> np.ndarray:
    """For every value but the first, whether it equals the one before (nulls are equal)."""
    import pyarrow.compute as pc

    codes = pc.fill_null(pc.dictionary_encode(column).indices, -1).to_numpy(zero_copy_only=False)
    return codes[1:] == codes[:-1]


def pieces(df: DataFrame, key: str, order: Sequence[str], last: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """(key, part, seq, whole, rows): the rows of each key, by ``order`` and then ``last``, nulls first.

    ``rows`` holds structs of ``fields`` and ``again``: whether the row equals the one before in key,
    order and last. Pieces follow each other by (part, seq). ``last`` only breaks ties and does not deal
    rows out, as texts would be heavy in the sample of the ranges. The result is written below the
    checkpoint folder, so that what was cut stays cut when an executor is lost.
    """
    order, last, fields = list(order), list(last), list(fields)
    names = list(dict.fromkeys([key, *order, *last, *fields]))
    rows = df.select(*names).repartitionByRange(key, *order).sortWithinPartitions(key, *order, *last)
    by_name = {f.name: f for f in df.select(*names).schema.fields}
    inner = T.StructType([*[T.StructField(f, by_name[f].dataType) for f in fields], T.StructField("again", T.BooleanType())])
    schema = T.StructType([
        T.StructField(key, by_name[key].dataType), T.StructField("part", T.IntegerType()), T.StructField("seq", T.IntegerType()),
        T.StructField("whole", T.BooleanType()), T.StructField("rows", T.ArrayType(inner)),
    ])
    texts = [f for f in fields if isinstance(by_name[f].dataType, (T.StringType, T.BinaryType))]

    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        from pyspark.sql.pandas.types import to_arrow_type

        part, seq, before = TaskContext.get().partitionId(), 0, None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            joined = pa.Table.from_batches([batch] if before is None else [before, batch]).combine_chunks()
            skip = joined.num_rows - n
            same = {name: _same(joined.column(name).combine_chunks()) for name in dict.fromkeys([key, *order, *last])}
            again = np.concatenate([np.zeros(1 - skip, bool), np.logical_and.reduce(list(same.values()))])
            before = batch.slice(n - 1)
            cut = np.zeros(n, bool)
            cut[0] = True
            cut[1:] = ~same[key][skip:]
            natural = np.flatnonzero(cut)
            length = np.arange(n) - np.repeat(natural, np.diff([*natural, n]))
            forced = np.zeros(n, bool)
            forced[1:] = length[1:] % ROWS == 0
            for name in texts:
                forced[[start for start, _ in slices(batch.column(name))]] = True
            begins = np.flatnonzero(cut | forced)
            ends = np.append(begins[1:], n)
            inside = np.append(cut, True)
            whole = inside[begins] & inside[ends]
            whole[0] = whole[-1] = False
            struct = pa.StructArray.from_arrays([*[batch.column(f) for f in fields], pa.array(again)], [*fields, "again"])
            held = pa.ListArray.from_arrays(pa.array(np.append(begins, n), pa.int32()), struct)
            places = pa.array(np.arange(seq, seq + len(begins)), pa.int32())
            seq += len(begins)
            yield pa.RecordBatch.from_arrays(
                [batch.column(key).take(pa.array(begins)), pa.array(np.full(len(begins), part), pa.int32()), places, pa.array(whole), held.cast(to_arrow_type(schema["rows"].dataType))],
                [key, "part", "seq", "whole", "rows"],
            )

    return settled(rows.mapInArrow(run, schema), "pieces")


def along(df: DataFrame, key: str, step: Callable, schema: str) -> DataFrame:
    """``step(key, rows)`` over all pieces of each key in their order: an iterator over dictionaries goes
    in, one dictionary comes out. Only pieces that are not whole are shuffled, by key; a task
    reads them as a stream, one Arrow batch at a time."""
    named, fields = df.columns, T.StructType.fromDDL(schema)

    def run(batches):
        from itertools import chain, groupby

        import pyarrow as pa

        from pyspark.sql.pandas.types import to_arrow_schema

        kind = to_arrow_schema(fields)

        def flow():
            for batch in batches:
                for start in range(0, batch.num_rows, 256):
                    part = batch.slice(start, 256)
                    yield from (dict(zip(named, row)) for row in zip(*[c.to_pylist() for c in part.columns]))

        made = []
        for value, group in groupby(flow(), key=lambda row: row[key]):
            first = next(group)
            made.append(step(value, chain([first], group)))
            if len(made) >= 2000:
                yield pa.RecordBatch.from_pylist(made, kind)
                made = []
        if made:
            yield pa.RecordBatch.from_pylist(made, kind)

    edges = df.filter("NOT whole").repartition(key).sortWithinPartitions(key, "part", "seq")
    return df.filter("whole").mapInArrow(run, schema).unionByName(edges.mapInArrow(run, schema))


def beside(df: DataFrame, thin: DataFrame) -> DataFrame:
    """``thin`` (part, seq, …) joined to the pieces of ``df`` that it names."""
    return df.join(thin, ["part", "seq"])


def before(edges: DataFrame, key: str, **columns) -> DataFrame:
    """(part, seq, …): aggregates of thin ``columns`` over the earlier pieces of the same key."""
    earlier = Window.partitionBy(key).orderBy("part", "seq").rowsBetween(Window.unboundedPreceding, -1)
    return edges.select("part", "seq", *[make.over(earlier).alias(name) for name, make in columns.items()])
