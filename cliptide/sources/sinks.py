"""Feature tables, result files, and reuse of tables that exist already."""

from __future__ import annotations

import hashlib
import json
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def write_features(df: DataFrame, path: str, partitions: Sequence[str] = ("dataset",), mode: str = "error") -> None:
    """Parquet feature table, one directory per partition value. Each task writes what it
    holds, so a huge dataset is written by many tasks."""
    df.write.mode(mode).partitionBy(*partitions).parquet(path)


def is_complete(spark: SparkSession, path: str) -> bool:
    """Whether a finished write left its marker at ``path``."""
    # Spark's readers hide the marker, so the file system is asked directly.
    marker = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return marker.getFileSystem(spark._jsc.hadoopConfiguration()).exists(marker)


def materialised(spark: SparkSession, path: str, compute: Callable[[], DataFrame], partitions: Sequence[str] = ()) -> DataFrame:
    """The table at ``path``: computed and written only if no finished write is there."""
    if not is_complete(spark, path):
        compute().write.mode("overwrite").partitionBy(*partitions).parquet(path)
    return spark.read.parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def write_json(df: DataFrame, path: str, mode: str = "error") -> None:
    df.write.mode(mode).json(path)


def chunk_line(stem: Column, chunk: Column, value: Column) -> Column:
    """``stem_chunk: value``"""
    return F.concat(stem, F.lit("_"), chunk.cast("string"), F.lit(": "), value.cast("string"))


def append_text(df: DataFrame, path: str, line: str = "line") -> None:
    df.select(line).write.mode("append").text(path)


def fingerprint(inputs: Sequence[DataFrame], params: Mapping[str, object] | None = None) -> str:
    """A digest of the files that ``inputs`` read (path, bytes, time of change), of their columns and of ``params``.

    Spark lists the files in parallel and adds up a hash of each; no content is read. Frames that read no files
    count by their columns alone; give what tells them apart in ``params``, whose values must be plain JSON.
    """
    facts = []
    for df in inputs:
        held, found = df.inputFiles(), None
        if held:
            seen = df.sparkSession.read.format("binaryFile").load(held)
            facts_of = F.concat_ws("\n", "path", F.col("length").cast("string"), F.unix_micros("modificationTime").cast("string"))
            hashes = [F.xxhash64(F.lit(seed), facts_of) for seed in (1, 2, 3, 4)]
            found = list(seen.agg(F.count(F.lit(1)), F.sum("length"), *[F.bit_xor(h) for h in hashes]).first())
        facts.append([df.schema.jsonValue(), found])
    return hashlib.sha256(json.dumps([facts, dict(params or {})], sort_keys=True).encode()).hexdigest()


class Versions:
    """A table below ``path`` whose versions are folders, published by one rename of a small manifest.

    Data are written to a new folder under ``data``. Only then does the manifest, written in full under a
    temporary name, take its final name ``manifests/<key>``, by a rename that fails if that name exists. A
    reader sees whole folders that a manifest names or nothing: a write that dies half way leaves only files that
    no manifest names. The rename must be atomic, as on HDFS and local disks; object stores need a store of
    manifests that has such a rename.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._hadoop = spark._jvm.org.apache.hadoop.fs
        self._fs = self._at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._hadoop.Path(f"{self.path}/{name}" if name else self.path)

    def find(self, key: str) -> dict | None:
        """The manifest published under ``key``."""
        place = self._at(f"manifests/{key}")
        if not self._fs.exists(place):
            return None
        stream = self._fs.open(place)
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def keys(self) -> list[str]:
        place = self._at("manifests")
        if not self._fs.exists(place):
            return []
        return sorted(n for n in (s.getPath().getName() for s in self._fs.listStatus(place)) if not n.startswith((".", "_")))

    def publish(self, key: str, write: Callable[[str], None], facts: Mapping[str, object] | None = None) -> dict:
        """Has ``write`` fill a new folder and names it under ``key``; if that is taken already, by an earlier run or
        one at the same time, the folder published first stays and is returned."""
        held = self.find(key)
        if held is not None:
            return held
        folder = f"data/{uuid.uuid4().hex}"
        write(f"{self.path}/{folder}")
        self._fs.mkdirs(self._at("manifests"))
        draft = self._at(f"manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(draft, False)
        try:
            out.write(bytearray(json.dumps({"folder": folder, **(facts or {})}, sort_keys=True).encode()))
        finally:
            out.close()
        context = self._hadoop.FileContext.getFileContext(draft.toUri(), self.spark._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self._hadoop.Options.Rename, 0)  # no overwriting
        try:
            context.rename(self._fs.makeQualified(draft), self._fs.makeQualified(self._at(f"manifests/{key}")), options)
        except Exception:
            first = self.find(key)
            if first is None:
                raise
            self._fs.delete(self._at(folder), True)
            self._fs.delete(draft, False)
            return first
        return self.find(key)


def _key_of(name: str) -> str:
    return hashlib.sha256(name.encode()).hexdigest()


def materialised_for(
    spark: SparkSession, path: str, inputs: Sequence[DataFrame], compute: Callable[[], DataFrame],
    params: Mapping[str, object] | None = None, partitions: Sequence[str] = (),
) -> DataFrame:
    """The table that ``compute`` makes of ``inputs`` with ``params``: computed once for each ``fingerprint`` of them.

    Changed input files or parameters give a new version; the versions before stay readable by their readers.
    """
    held = Versions(spark, path).publish(fingerprint(inputs, params), lambda folder: compute().write.partitionBy(*partitions).parquet(folder))
    return spark.read.parquet(f"{path}/{held['folder']}")


def append_batch(df: DataFrame, path: str, batch: str, line: str = "line") -> None:
    """Appends text lines as batch ``batch``; a batch that was appended before is not written again."""
    Versions(df.sparkSession, path).publish(_key_of(batch), lambda folder: df.select(line).write.text(folder), {"batch": batch})


def read_batches(spark: SparkSession, path: str) -> DataFrame:
    """(batch, value): the lines of all batches appended whole. No batch at all: no rows."""
    versions = Versions(spark, path)
    held = [versions.find(key) for key in versions.keys()]
    if not held:
        return spark.createDataFrame([], "batch string, value string")
    lines = spark.read.text([f"{path}/{m['folder']}" for m in held]).select("value", F.col("_metadata.file_path").alias("file"))
    names = F.create_map(*[F.lit(x) for m in held for x in (m["folder"].rsplit("/", 1)[-1], m["batch"])])
    return lines.select(names[F.element_at(F.split("file", "/"), -2)].alias("batch"), "value")
