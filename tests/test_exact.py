"""Ranks, cuts, indexes, scans and medians against plain Python, with hot groups and ties."""

import hashlib
import random
import statistics

import pytest
from pyspark.sql import functions as F

from cliptide.operators import curate, exact, sample


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """3,000 rows; two thirds of them in one class."""
    rng = random.Random(5)
    rows = [(f"k{i}", 0 if rng.random() < 0.67 else rng.choice([1, 2]), rng.randint(0, 50)) for i in range(3000)]
    return rows, spark.createDataFrame(rows, "key string, label int, value int").repartition(7)


@pytest.mark.parametrize("prefix", [1, 2, 4])
def test_hash_rank(skewed, prefix):
    rows, df = skewed
    got = {r.key: r.rank for r in exact.hash_rank(df, "key", "label", 9, prefix=prefix).collect()}
    for label in (0, 1, 2):
        keys = sorted((k for k, l, _ in rows if l == label), key=lambda k: digest(9, k))
        assert [got[k] for k in keys] == list(range(1, len(keys) + 1))


@pytest.mark.parametrize("prefix", [1, 3])
@pytest.mark.parametrize("by", [[], ["label"]])
def test_hash_parts(skewed, by, prefix):
    rows, df = skewed

    def sizes(totals):
        return totals.withColumn("cuts", F.array(F.lit(0).cast("bigint"), F.lit(10).cast("bigint"), F.lit(200).cast("bigint"), F.lit(10**6).cast("bigint")))

    got = {r.key: r.part for r in exact.hash_parts(df, "key", by, sizes, 4, seed=3, prefix=prefix).collect()}
    groups = {}
    for key, label, _ in rows:
        groups.setdefault(label if by else 0, []).append(key)
    for keys in groups.values():
        for i, key in enumerate(sorted(keys, key=lambda k: digest(3, k))):
            assert got[key] == (1 if i < 10 else 2 if i < 200 else 3)


def test_many_groups_use_the_shuffled_way(skewed):
    rows, df = skewed
    small = exact.small_table(df.groupBy("label").count(), max_rows=2)
    assert small.count() == 3
    assert exact.small_table(df.groupBy("label").count(), max_rows=3).count() == 3


def test_row_index(skewed):
    rows, df = skewed
    got = {r.key: r.idx for r in exact.row_index(df, ["label", "key"]).collect()}
    assert [got[k] for _, k in sorted((l, k) for k, l, _ in rows)] == list(range(len(rows)))


@pytest.mark.parametrize("how", ["sum", "max"])
def test_running(spark, how):
    rng = random.Random(2)
    rows = [(c, i, rng.randint(-9, 9)) for c, n in (("a", 500), ("b", 3)) for i in range(n)]
    df = spark.createDataFrame(rows, "clip string, pos int, v int").repartition(5)
    got = {(r.clip, r.pos): r.running for r in exact.running(df, "clip", "pos", "v", how, block=16).collect()}
    for clip in ("a", "b"):
        seen = []
        for _, pos, v in [r for r in rows if r[0] == clip]:
            seen.append(v)
            assert got[clip, pos] == (sum(seen) if how == "sum" else max(seen))


def test_exact_median_with_ties(spark):
    rng = random.Random(4)
    rows = [("tied", 5.0)] * 400 + [("tied", 1.0)] * 100 + [("even", float(v)) for v in (1, 2, 3, 10)] + [("one", 7.0)]
    rows += [("wide", rng.gauss(0, 100)) for _ in range(2001)] + [("split", 0.0)] * 50 + [("split", 1.0)] * 50 + [("gap", None)]
    df = spark.createDataFrame(rows, "g string, v double")
    for few in (True, False):
        got = {r.g: r.median for r in exact.exact_median(df, "g", "v", accuracy=100, few=few).collect()}
        want = {g: statistics.median(v for k, v in rows if k == g and v is not None) for g in ("tied", "even", "one", "wide", "split")}
        assert got == want


def test_balance_tie_and_absent_class(spark):
    tie = spark.createDataFrame([(f"f{i}", i % 2) for i in range(10)], "filename string, tv int")
    assert sample.balance_binary(tie).count() == 10
    only = tie.filter("tv = 0")
    assert sample.balance_binary(only).count() == 0
    assert sample.balance_classes(only).count() == 5


def test_quota_errors(spark):
    rows = [("a", "cooking", 0), ("b", "cooking", 0), ("c", "working", 0), ("d", "watching tv", 1)]
    df = spark.createDataFrame(rows, "filename string, activity string, tv int")
    with pytest.raises(Exception, match="outnumber"):
        sample.shrink_to_quota(df).collect()
    with pytest.raises(Exception, match="too few"):
        sample.shrink_to_quota(df.filter("activity <> 'cooking'").filter("tv = 1").unionByName(
            df.filter("tv = 1").withColumn("filename", F.lit("e")))).collect()


def test_group_split_shares_no_participant(spark):
    df = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("filename"), (F.col("id") % 41).alias("participant_id"))
    splits = {}
    for r in sample.group_split(df).collect():
        splits.setdefault(r.participant_id, set()).add(r.split)
    assert all(len(s) == 1 for s in splits.values())
    sizes = [sum(s == {name} for s in splits.values()) for name in ("train", "val", "test")]
    assert sizes == [28, 6, 7]


def test_block_folds_of_540(spark):
    df = spark.range(540).select(sample.block_fold(F.col("id")).alias("fold"))
    assert sorted((r.fold, r["count"]) for r in df.groupBy("fold").count().collect()) == [(0, 140), (1, 140), (2, 140), (3, 120)]


def test_equal_folds_drop_the_remainder(spark):
    df = spark.range(103).select(F.concat(F.lit("f"), "id").alias("filename"))
    counts = sample.equal_folds(df, "filename").groupBy("fold").count().collect()
    assert sorted((r.fold, r["count"]) for r in counts) == [(i, 20) for i in range(5)]
    assert sample.batches(df, "filename", 1).agg(F.max("batch")).first()[0] == 3


def test_sliding_fold_clamps_and_refuses(spark):
    df = spark.createDataFrame([(f"f{i:03d}", int(i >= 90)) for i in range(100)], "filename string, tv int")
    last = sample.sliding_balanced_fold(df, ["filename"], fold=99)
    assert last.filter("tv = 1").count() == 10
    assert last.filter("tv = 0").agg(F.min("filename"), F.max("filename")).first()[:] == ("f080", "f089")
    with pytest.raises(Exception, match="too small"):
        sample.sliding_balanced_fold(df.filter("filename <= 'f090'"), ["filename"]).collect()


def test_curation_edges(spark):
    rows = [("a", "1", "1", 1), ("a", " ", "2", 2), ("b", None, "3", 2), ("b", "", "4", 1), ("c", "1", "5", 1), (None, "1", "6", 1)]
    df = curate.clean_flags(spark.createDataFrame(rows, "filename string, tv string, id string, ord int"), ["tv"])
    kept = curate.curated_labels(df, ["ord"], keep=["id"]).collect()
    assert sorted((r.filename, r.tv, r.id) for r in kept) == [("b", 0, "4"), ("c", 1, "5")]
    again = curate.curated_labels(df, ["ord", "id"], keep=["id"]).collect()
    assert sorted((r.filename, r.tv, r.id) for r in again) == [("b", 0, "4"), ("c", 1, "5")]
    assert curate.agreed(df).count() == 3
    assert curate.keep_first(df, "filename", ["ord"]).filter("filename = 'b'").first().id == "4"
    with pytest.raises(Exception, match="not a whole number: x"):
        curate.clean_flags(df.withColumn("tv", F.lit("x")), ["tv"]).collect()


def test_cut_pass_does_not_shuffle_rows(spark):
    """The last pass over whole rows only joins a small local table."""
    df = spark.range(1000).select(F.concat(F.lit("f"), "id").alias("filename"), (F.col("id") % 3).cast("int").alias("tv"), F.col("id").alias("wide"))
    plan = sample.balance_classes(df)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan
    assert "hashpartitioning" not in plan
