"""Tables kept by a fingerprint of their inputs, and appends that a second run does not repeat."""

import os

import pytest
from pyspark.sql import functions as F

from cliptide.sources import sinks


def test_computed_again_only_for_changed_input_or_parameters(spark, tmp_path):
    source, path, calls = str(tmp_path / "source"), str(tmp_path / "table"), []
    spark.range(5).write.parquet(source)

    def ask(params=None):
        rows = spark.read.parquet(source)

        def compute():
            calls.append(params)
            return rows.withColumn("twice", F.col("id") * 2)

        return sinks.materialised_for(spark, path, [rows], compute, params)

    first = ask()
    assert ask().count() == 5 and len(calls) == 1
    ask({"rate": 16_000})
    ask({"rate": 16_000})
    assert len(calls) == 2
    spark.range(5, 8).write.mode("append").parquet(source)
    assert ask().count() == 8 and len(calls) == 3
    assert first.count() == 5  # the version before stays as it was


def test_half_write_is_never_seen(spark, tmp_path):
    path = str(tmp_path / "table")
    broken = spark.range(40).repartition(4).withColumn("x", F.when(F.col("id") == 39, F.raise_error(F.lit("lost"))).otherwise(F.col("id")))
    with pytest.raises(Exception, match="lost"):
        sinks.materialised_for(spark, path, [], lambda: broken, {"of": 1})
    assert sinks.Versions(spark, path).keys() == []
    assert sinks.materialised_for(spark, path, [], lambda: spark.range(3), {"of": 1}).count() == 3


def test_first_of_two_writers_stays(spark, tmp_path):
    """Another writer publishes while this one is still writing: its folder goes, the published one is returned."""
    path = str(tmp_path / "table")
    versions = sinks.Versions(spark, path)
    other = {}

    def write(folder):
        spark.range(2).write.parquet(folder)
        other.update(sinks.Versions(spark, path).publish("k", lambda f: spark.range(9).write.parquet(f)))

    held = versions.publish("k", write)
    assert held == other
    assert spark.read.parquet(f"{path}/{held['folder']}").count() == 9
    assert len(os.listdir(tmp_path / "table" / "data")) == 1


def test_append_batches(spark, tmp_path):
    path = str(tmp_path / "lines")
    assert sinks.read_batches(spark, path).count() == 0
    lines = lambda *values: spark.createDataFrame([(v,) for v in values], "line string")
    for _ in range(2):
        sinks.append_batch(lines("a", "a", "b"), path, "one/1")
    sinks.append_batch(lines("a"), path, "two")
    sinks.append_batch(lines("x").limit(0), path, "none")
    got = sorted((r.batch, r.value) for r in sinks.read_batches(spark, path).collect())
    assert got == [("one/1", "a"), ("one/1", "a"), ("one/1", "b"), ("two", "a")]
