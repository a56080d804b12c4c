"""Small helpers that several corpus operators share."""

from __future__ import annotations

import pickle
import uuid
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ASCII_SPACE = " \t\n\x0b\x0c\r"


def free_name(df: DataFrame, base: str) -> str:
    """``base``, with underscores added until no column of ``df`` bears it (in any letter case)."""
    taken = {c.lower() for c in df.columns}
    while base.lower() in taken:
        base += "_"
    return base


def ascii_lower(text: Column) -> Column:
    """A-Z to a-z; all other letters stay, unlike with ``lower``."""
    return F.translate(text, UPPER, UPPER.lower())


def held_out(doc_id: Column) -> Column:
    """The rows no model may learn from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def unique(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex}"


def table(spark, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def plain_bytes(column) -> list[bytes | None]:
    """The values of an Arrow string column as bytes."""
    import pyarrow as pa

    return column.cast(pa.large_binary()).to_pylist()


def append_struct(docs: DataFrame, column: str, out: str, fields: str, make, read=plain_bytes, limit: int | None = None) -> DataFrame:
    """``docs`` with a struct column ``out`` of ``fields``, computed from one column.

    ``make(values)`` gets a list of texts as UTF-8 bytes (or None), or whatever ``read`` makes of
    the Arrow column, and returns one list, numpy or Arrow array per field. It is called for slices
    of a batch of about ``limit`` bytes (``SLICE`` by default), so that memory does not depend on how many long texts meet
    in a batch.
    """
    from pyspark.sql import types as T

    kind = T.StructType.fromDDL(fields)
    schema = T.StructType([*docs.schema.fields, T.StructField(out, kind)])
    names = [*docs.columns, out]
    place = names.index(column)

    def run(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        types = [to_arrow_type(f.dataType) for f in kind.fields]
        for batch in batches:
            for start, stop in slices(batch.column(place), limit or SLICE):
                part = batch.slice(start, stop - start)
                made = make(read(part.column(place)))
                arrays = [m if isinstance(m, pa.Array) else pa.array(m, t) for m, t in zip(made, types)]
                struct = pa.StructArray.from_arrays(arrays, kind.names)
                yield pa.RecordBatch.from_arrays([*part.columns, struct], names)

    return docs.mapInArrow(run, schema)


SLICE = 4 << 20


def slices(column, limit: int = SLICE):
    """(start, stop) of runs of rows with about ``limit`` bytes of text together."""
    import pyarrow as pa
    import pyarrow.compute as pc

    texts = pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type)
    lengths = pc.binary_length(column) if texts else pc.multiply(pc.list_value_length(column), 4)
    sizes = pc.fill_null(lengths, 0).to_pylist()
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size + 64
    if sizes:
        yield start, len(sizes)


class Sent:
    """A broadcast that carries its classes along, so that executors need no installation."""

    def __init__(self, spark, value):
        from pyspark import cloudpickle

        self._pickled = spark.sparkContext.broadcast(cloudpickle.dumps(value))

    @property
    def value(self):
        if "_value" not in self.__dict__:
            self._value = pickle.loads(self._pickled.value)
        return self._value
