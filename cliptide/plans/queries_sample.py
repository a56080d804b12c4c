"""Queries for seeded draws, balancing, splits and folds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.operators import sample
from cliptide.operators.exact import hash_rank, row_index
from cliptide.plans import bindings as b
from cliptide.plans.registry import query


def ranked(source: str, key: str = "filename", by: str | None = None, seed: str = "42", name: str = "ranked") -> str:
    part = f"PARTITION BY {by} " if by else ""
    return (
        f"{name} AS (SELECT *, row_number() OVER ({part}ORDER BY md5(concat_ws(':', '{seed}', {key})), {key}) AS r"
        f" FROM {source})"
    )


@query("t3_seeded_order", f"WITH {b.CUR}, {ranked('cur', seed='7')} SELECT filename, r AS position FROM ranked")
def _(spark, sf):
    return hash_rank(b.settled_curated(spark, sf), "filename", seed=7, name="position").select("filename", "position")


@query("t3_shuffled", f"WITH {b.CUR} SELECT filename, tv FROM cur")
def _(spark, sf):
    return sample.shuffled(b.settled_curated(spark, sf), "filename", 7).select("filename", "tv")


@query(
    "b1_balance_binary",
    f"""WITH {b.CUR}, {ranked('cur', by='tv')},
    quota AS (SELECT least(count(*) FILTER (tv = 0), count(*) FILTER (tv = 1)) AS q FROM cur)
    SELECT filename, tv, participant_id FROM ranked, quota WHERE r <= q""",
)
def _(spark, sf):
    return sample.balance_binary(b.settled_curated(spark, sf)).select("filename", "tv", "participant_id")


@query(
    "b2_balance_classes",
    f"""WITH {b.ACT}, {ranked('act', key='audio_file', by='activity')},
    quota AS (SELECT min(n) AS q FROM (SELECT count(*) AS n FROM act GROUP BY activity))
    SELECT audio_file, activity FROM ranked, quota WHERE r <= q""",
)
def _(spark, sf):
    return sample.balance_classes(b.activities(spark, sf), "audio_file", "activity")


@query(
    "b3_shrink_to_quota",
    f"""WITH {b.BINACT}, strata AS (
      SELECT *, CASE WHEN tv = 1 THEN 'positive' WHEN activity IN ('absence', 'working') THEN 'shrink' ELSE 'other' END
        AS stratum FROM bin),
    {ranked('strata', by='stratum')},
    quota AS (SELECT count(*) FILTER (stratum = 'positive') - count(*) FILTER (stratum = 'other') AS q FROM strata)
    SELECT filename, activity, CAST(tv AS INTEGER) AS tv FROM ranked, quota WHERE stratum <> 'shrink' OR r <= q""",
)
def _(spark, sf):
    return sample.shrink_to_quota(b.binary_activities(spark, sf)).select("filename", "activity", "tv")


def _merged(stratified: bool) -> str:
    by = "dataset, tv" if stratified else "dataset"
    return f"""WITH {b.CUR}, tagged AS (SELECT *, participant_id % 3 AS dataset FROM cur),
    {ranked('tagged', by='dataset, tv')},
    least AS (SELECT dataset, min(n) AS q FROM (SELECT dataset, tv, count(*) AS n FROM tagged GROUP BY 1, 2) GROUP BY 1),
    within AS (SELECT filename, participant_id, tv, k.dataset FROM ranked k JOIN least l ON k.dataset = l.dataset WHERE r <= q),
    {ranked('within', by=by, seed='42-between', name='again')},
    size AS (SELECT min(n) AS q FROM (SELECT count(*) AS n FROM within GROUP BY {by}))
    SELECT filename, tv, dataset FROM again, size WHERE r <= q"""


@query("b4_merge_balanced", _merged(False))
def _(spark, sf):
    tagged = b.settled_curated(spark, sf).withColumn("dataset", F.col("participant_id") % 3)
    return sample.merge_balanced(tagged).select("filename", "tv", "dataset")


@query("b4_merge_balanced_stratified", _merged(True))
def _(spark, sf):
    tagged = b.settled_curated(spark, sf).withColumn("dataset", F.col("participant_id") % 3)
    return sample.merge_balanced(tagged, stratified=True).select("filename", "tv", "dataset")


_SPLIT = """CASE WHEN r <= n - ceil(round(n * 0.3, 9)) THEN 'train'
  WHEN r <= n - ceil(ceil(round(n * 0.3, 9)) / 2) THEN 'val' ELSE 'test' END AS split"""


@query(
    "b5_group_split",
    f"""WITH {b.CUR}, groups AS (SELECT DISTINCT participant_id FROM cur),
    {ranked('groups', key='participant_id')}, total AS (SELECT count(*) AS n FROM groups),
    parts AS (SELECT participant_id, {_SPLIT} FROM ranked, total)
    SELECT c.filename, c.participant_id, p.split FROM cur c JOIN parts p ON c.participant_id = p.participant_id""",
)
def _(spark, sf):
    return sample.group_split(b.settled_curated(spark, sf)).select("filename", "participant_id", "split")


@query(
    "b6_stratified_split",
    f"""WITH {b.BINACT}, {ranked('bin', by='tv')}, total AS (SELECT tv, count(*) AS n FROM bin GROUP BY tv)
    SELECT filename, CAST(k.tv AS INTEGER) AS tv, {_SPLIT} FROM ranked k JOIN total t ON k.tv = t.tv""",
)
def _(spark, sf):
    return sample.stratified_split(b.binary_activities(spark, sf)).select("filename", "tv", "split")


@query(
    "b7_block_folds",
    "SELECT vec_id, CAST(floor(vec_id / 20) % 4 AS INTEGER) AS fold FROM embeddings",
)
def _(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", sample.block_fold(F.col("vec_id")).alias("fold"))


@query(
    "b7_block_folds_by_order",
    f"""WITH {b.CUR}, placed AS (SELECT filename, row_number() OVER (ORDER BY filename) - 1 AS idx FROM cur)
    SELECT filename, idx, CAST(floor(idx / 20) % 4 AS INTEGER) AS fold FROM placed""",
)
def _(spark, sf):
    placed = row_index(b.settled_curated(spark, sf).select("filename"), "filename")
    return placed.withColumn("fold", sample.block_fold(F.col("idx")))


@query(
    "b8_shuffled_folds",
    f"WITH {b.CUR}, {ranked('cur')} SELECT filename, CAST((r - 1) % 4 AS INTEGER) AS fold FROM ranked",
)
def _(spark, sf):
    return sample.shuffled_folds(b.settled_curated(spark, sf), "filename").select("filename", "fold")


NESTED = f"""{b.CUR}, {ranked('cur')}, total AS (SELECT count(*) // 5 AS each FROM cur),
    folds AS (SELECT filename, tv, CAST((r - 1) // each AS INTEGER) AS fold FROM ranked, total WHERE r <= each * 5)"""


@query(
    "b9_nested_folds",
    f"""WITH {NESTED} SELECT filename, fold,
      CASE WHEN fold = 2 THEN 'test' WHEN fold = 3 THEN 'val' ELSE 'train' END AS role FROM folds""",
)
def _(spark, sf):
    folds = sample.equal_folds(b.settled_curated(spark, sf), "filename")
    return sample.nested_roles(folds, test=2, val=2).select("filename", "fold", "role")


@query(
    "b10_fold_roles",
    f"""WITH {NESTED} SELECT filename, fold, CAST(h.held_out AS INTEGER) AS held_out,
      CASE WHEN fold = h.held_out THEN 'val' ELSE 'train' END AS role FROM folds, range(5) h(held_out)""",
)
def _(spark, sf):
    folds = sample.equal_folds(b.settled_curated(spark, sf), "filename")
    return sample.fold_roles(folds, 5).select("filename", "fold", "held_out", "role")


@query(
    "b10_train_rows",
    "SELECT vec_id, CAST(vec_id % 4 AS INTEGER) AS fold FROM embeddings WHERE vec_id % 4 <> 1",
)
def _(spark, sf):
    folds = b.table(spark, sf, "embeddings").select("vec_id", (F.col("vec_id") % 4).cast("int").alias("fold"))
    return sample.train_rows(folds, 1)


@query(
    "b11_batches",
    f"WITH {b.CUR}, {ranked('cur', seed='3')} SELECT filename, CAST(floor((r - 1) / 32) AS BIGINT) AS batch FROM ranked",
)
def _(spark, sf):
    return sample.batches(b.settled_curated(spark, sf), "filename", epoch=3).select("filename", "batch")


@query(
    "w14_sliding_balanced_fold",
    f"""WITH {b.CUR}, sizes AS (SELECT count(*) FILTER (tv = 0) AS n0, count(*) FILTER (tv = 1) AS n1 FROM cur),
    plan AS (SELECT CASE WHEN n0 > n1 THEN 0 ELSE 1 END AS major, least(n0, n1) AS small,
      CAST(floor(least(n0, n1) * 0.5) AS BIGINT) AS step, abs(n0 - n1) AS gap FROM sizes),
    start AS (SELECT *, (least(3, gap // step + 1) - 1) * step AS s FROM plan),
    placed AS (SELECT filename, tv, row_number() OVER (PARTITION BY tv ORDER BY filename) - 1 AS i FROM cur)
    SELECT filename, tv FROM placed, start WHERE tv <> major OR (i >= s AND i < s + small)""",
)
def _(spark, sf):
    return sample.sliding_balanced_fold(b.settled_curated(spark, sf), ["filename"], fold=3).select("filename", "tv")
