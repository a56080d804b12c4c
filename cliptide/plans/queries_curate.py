"""Queries over annotation tables: projections, filters, joins, profiles, set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.functions import labels
from cliptide.operators import curate, evaluate
from cliptide.plans import bindings as b
from cliptide.plans import jobs
from cliptide.plans.registry import query


@query("p1_lower_columns", f"WITH {b.ANN} SELECT filename, participant_id AS id, tv_text AS tv, coder FROM ann")
def _(spark, sf):
    return curate.lower_columns(b.annotations(spark, sf)).select("filename", "id", "tv", "coder")


@query("p2_rename", f"WITH {b.ANN} SELECT filename, participant_id, coder, tv_text AS tv FROM ann")
def _(spark, sf):
    lowered = curate.lower_columns(b.annotations(spark, sf))
    return curate.rename(lowered, {"id": "participant_id"}).select("filename", "participant_id", "coder", "tv")


@query("p3_clean_flags", f"WITH {b.ANN} SELECT filename, participant_id, coder, ord1, ord2, tv, problems FROM clean")
def _(spark, sf):
    return b.clean(spark, sf).select("filename", "participant_id", "coder", "ord1", "ord2", "tv", "problems")


@query("p4_without_problems", f"WITH {b.ANN} SELECT filename, coder, ord1, ord2, tv FROM clean WHERE problems = 0")
def _(spark, sf):
    return curate.without_problems(b.clean(spark, sf)).select("filename", "coder", "ord1", "ord2", "tv")


@query(
    "p5_drop_activities",
    f"""WITH {b.ACT}, gaps AS (SELECT audio_file, nullif(activity, 'cooking') AS activity FROM act)
    SELECT audio_file, activity FROM gaps WHERE activity IS NULL OR activity NOT IN ('unknown', 'dont use', 'other')""",
)
def _(spark, sf):
    gaps = b.activities(spark, sf).withColumn("activity", F.nullif("activity", F.lit("cooking")))
    return curate.drop_activities(gaps, ["unknown", "dont use", "other"])


@query(
    "p6_binary_target",
    f"""WITH {b.ACT} SELECT audio_file, CAST(CASE WHEN activity = 'watching tv' THEN 1 ELSE 0 END AS INTEGER) AS tv
    FROM act""",
)
def _(spark, sf):
    return curate.binary_activity(b.activities(spark, sf)).select("audio_file", "tv")


@query("p7_feature_path", f"WITH {b.ACT} SELECT concat('features/node/', audio_file, '.npy') AS path FROM act")
def _(spark, sf):
    return b.activities(spark, sf).select(labels.feature_path("features/node", F.col("audio_file")).alias("path"))


@query(
    "p8_stem",
    r"""SELECT page_id, split_part(url, '/', -1) AS base,
      regexp_replace(split_part(url, '/', -1) || '.part.wav', '\.[^.]*$', '') AS last_dot,
      split_part(split_part(url, '/', -1) || '.part.wav', '.', 1) AS first_dot FROM pages""",
)
def _(spark, sf):
    path = F.concat("url", F.lit(".part.wav"))
    return b.table(spark, sf, "pages").select(
        "page_id",
        labels.base_name(F.col("url")).alias("base"),
        labels.stem(path).alias("last_dot"),
        labels.stem(path, first_dot=True).alias("first_dot"),
    )


SLUGS = """slugs AS (
  SELECT doc_id, concat_ws('-', lpad(CAST(doc_id % 10 AS VARCHAR), 1, '0') || CAST((doc_id // 2) % 2 AS VARCHAR)
         || CAST(doc_id % 2 AS VARCHAR), lang, source) AS name FROM documents)"""


def _slugs(spark, sf):
    bits = F.concat(
        (F.col("doc_id") % 10).cast("string"),
        (F.floor(F.col("doc_id") / 2) % 2).cast("string"),
        (F.col("doc_id") % 2).cast("string"),
    )
    return b.table(spark, sf, "documents").select("doc_id", F.concat_ws("-", bits, "lang", "source").alias("name"))


@query(
    "p9_slug_labels",
    f"""WITH {SLUGS} SELECT doc_id, name,
      CAST(split_part(name, '-', 1) IN ('100', '101', '110', '111') AS INTEGER) AS interaction,
      CAST(split_part(name, '-', 1) IN ('010', '011', '110', '111') AS INTEGER) AS tv FROM slugs""",
)
def _(spark, sf):
    name = F.col("name")
    return _slugs(spark, sf).select(
        "doc_id", "name", labels.slug_interaction(name).alias("interaction"), labels.slug_tv(name).alias("tv")
    )


@query(
    "p10_first_char_label",
    f"WITH {SLUGS} SELECT doc_id, substr(name, 1, 1) AS label FROM slugs",
)
def _(spark, sf):
    path = F.concat(F.lit("clips/"), "name")
    return _slugs(spark, sf).select("doc_id", labels.first_char_label(path).alias("label"))


@query(
    "p11_name_facts",
    """SELECT doc_id, CAST(doc_id % 2 AS INTEGER) AS class_label, lang AS microphone,
      CASE WHEN doc_id % 5 = 0 THEN 'NA' ELSE source END AS speaker, CAST(doc_id % 3 + 1 AS VARCHAR) AS category
    FROM documents""",
)
def _(spark, sf):
    speaker = F.when(F.col("doc_id") % 5 == 0, "0").otherwise(F.col("source"))
    name = F.concat(
        F.concat_ws("-", (F.col("doc_id") % 2).cast("string"), "lang", speaker, (F.col("doc_id") % 3 + 1).cast("string")),
        F.lit(".wav"),
    )
    named = b.table(spark, sf, "documents").select("doc_id", name.alias("name"))
    return named.select("doc_id", *labels.name_facts(F.col("name")))


@query(
    "p12_label_slice",
    "SELECT event_id, value, CAST(event_type = 'click' AS INTEGER) AS click FROM events WHERE event_type = 'click'",
)
def _(spark, sf):
    flagged = b.table(spark, sf, "events").withColumn("click", (F.col("event_type") == "click").cast("int"))
    return curate.label_slice(flagged, "click", 1).select("event_id", "value", "click")


@query(
    "p13_threshold",
    f"WITH {b.MEM} SELECT clip_id, CAST(m0 > 0.5 AS INTEGER) AS is_tv, CAST(m1 < 0.5 AS INTEGER) AS not_other FROM mem",
)
def _(spark, sf):
    return b.members(spark, sf).select(
        "clip_id", labels.above(F.col("m0")).alias("is_tv"), labels.below(F.col("m1")).alias("not_other")
    )


FILES = "files AS (SELECT concat('clip_', CAST(vec_id AS VARCHAR)) AS filename, vec_id FROM embeddings)"


def _files(spark, sf):
    name = F.concat(F.lit("clip_"), F.col("vec_id").cast("string"))
    return b.table(spark, sf, "embeddings").select(name.alias("filename"), "vec_id")


@query(
    "j1_with_features",
    f"WITH {b.ANN}, {FILES} SELECT filename, coder, ord1, ord2, tv FROM clean WHERE filename IN (SELECT filename FROM files)",
)
def _(spark, sf):
    return curate.with_features(b.clean(spark, sf), _files(spark, sf)).select("filename", "coder", "ord1", "ord2", "tv")


@query(
    "j2_labelled",
    "SELECT d.doc_id, d.lang, l.quality AS tv FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
)
def _(spark, sf):
    truth = b.table(spark, sf, "labels").select("doc_id", F.col("quality").alias("tv"))
    return curate.labelled(b.table(spark, sf, "documents").select("doc_id", "lang"), truth, "doc_id")


@query(
    "j3_feature_lookup",
    f"""WITH {b.CUR}, {FILES}
    SELECT c.filename, c.tv, f.vec_id FROM cur c JOIN files f ON c.filename = f.filename""",
)
def _(spark, sf):
    return curate.feature_lookup(b.curated(spark, sf).select("filename", "tv"), _files(spark, sf))


@query(
    "j4_missing_features",
    f"WITH {b.CUR}, {FILES} SELECT filename, tv FROM cur WHERE filename NOT IN (SELECT filename FROM files)",
)
def _(spark, sf):
    return curate.missing_features(b.curated(spark, sf).select("filename", "tv"), _files(spark, sf))


@query("a1_coder_agreement", f"WITH {b.CUR} SELECT filename, coder, ord1, ord2, tv FROM agreed")
def _(spark, sf):
    return curate.agreed(b.clean(spark, sf)).select("filename", "coder", "ord1", "ord2", "tv")


@query(
    "a2_keep_first",
    f"""WITH {b.ANN} SELECT filename, participant_id, coder, ord1, ord2, tv FROM (
      SELECT *, row_number() OVER (PARTITION BY filename ORDER BY coder, ord1, ord2) AS rn FROM clean) WHERE rn = 1""",
)
def _(spark, sf):
    first = curate.keep_first(b.clean(spark, sf), "filename", b.ORDER)
    return first.select("filename", "participant_id", "coder", "ord1", "ord2", "tv")


@query("curated_labels", f"WITH {b.CUR} SELECT filename, participant_id, tv FROM cur")
def _(spark, sf):
    return b.curated(spark, sf).select("filename", "participant_id", "tv")


@query(
    "a3_class_counts",
    f"""WITH {b.CUR} SELECT count(*) AS records, count(*) FILTER (tv > 0) AS positive,
      count(*) FILTER (tv <= 0) AS negative FROM cur""",
)
def _(spark, sf):
    return curate.class_counts(b.curated(spark, sf))


@query(
    "a4_dataset_profile",
    f"""WITH {b.CUR} SELECT participant_id % 3 AS dataset, count(*) AS records,
      count(DISTINCT participant_id) AS participants, CAST(sum(tv) AS BIGINT) AS positives FROM cur GROUP BY 1""",
)
def _(spark, sf):
    tagged = b.curated(spark, sf).withColumn("dataset", F.col("participant_id") % 3)
    return curate.dataset_profile(tagged, ["dataset"])


@query(
    "a5_corpus_profile",
    """SELECT CASE WHEN quality IS NOT NULL THEN 8000 * (1 + d.doc_id % 3) END AS sample_rate, count(*) AS files,
      count(*) FILTER (quality IS NULL) AS failed,
      count(*) FILTER (quality IS NOT NULL AND toxic + 1 > 1) AS mono_converted
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id GROUP BY 1""",
)
def _(spark, sf):
    documents = b.table(spark, sf, "documents").select("doc_id")
    scanned = documents.join(b.table(spark, sf, "labels"), "doc_id", "left").select(
        (F.lit(8000) * (1 + F.col("doc_id") % 3)).alias("sr"),
        (F.col("toxic") + 1).alias("channels"),
        F.when(F.col("quality").isNull(), "unreadable").alias("error"),
    )
    return evaluate.corpus_profile(scanned)


KNOWN = {
    "speaker": [f"src{i}" for i in range(20)] + ["watch"],
    "microphone": ["de", "en", "es", "fr", "it"],
    "class_label": ["0", "1"],
    "category": ["1", "2", "3", "4"],
}
_WANTED = ", ".join(f"('{d}', '{v}')" for d, vs in KNOWN.items() for v in vs)


@query(
    "a6_duration_totals",
    f"""WITH {b.REC}, long AS (
      SELECT 'speaker' AS dimension, speaker AS value, duration FROM rec
      UNION ALL SELECT 'microphone', microphone, duration FROM rec
      UNION ALL SELECT 'class_label', CAST(class_label AS VARCHAR), duration FROM rec
      UNION ALL SELECT 'category', category, duration FROM rec WHERE class_label = 1),
    wanted(dimension, value) AS (VALUES {_WANTED})
    SELECT w.dimension, w.value, round(coalesce(sum(round(duration / 60, 2)), 0.0), 6) AS minutes
    FROM wanted w LEFT JOIN long l ON w.dimension = l.dimension AND w.value = l.value GROUP BY 1, 2""",
)
def _(spark, sf):
    totals = evaluate.duration_totals(b.recordings(spark, sf), KNOWN)
    return totals.withColumn("minutes", F.round("minutes", 6))


@query(
    "a7_last_value",
    f"WITH {b.REC} SELECT microphone, max_by(duration, doc_id) AS duration FROM rec GROUP BY 1",
)
def _(spark, sf):
    return evaluate.last_value(b.recordings(spark, sf), "microphone", "duration", "doc_id")


@query(
    "a16_run_summary",
    """SELECT count(quality) FILTER (toxic = 0) AS processed, count(*) AS total,
      count(*) FILTER (quality = 1 AND toxic = 0) AS positive
    FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
)
def _(spark, sf):
    documents = b.table(spark, sf, "documents").select("doc_id")
    run = documents.join(b.table(spark, sf, "labels"), "doc_id", "left").select(
        F.col("doc_id").alias("filename"),
        F.col("quality").alias("tv"),
        F.when(F.col("toxic") == 1, "unreadable").alias("error"),
    )
    return evaluate.run_summary(run)


@query(
    "a18_smallest_class",
    f"WITH {b.CUR} SELECT min(n) AS min_class_size FROM (SELECT count(*) AS n FROM cur GROUP BY tv)",
)
def _(spark, sf):
    return curate.smallest_class(b.curated(spark, sf))


@query(
    "u1_union_all",
    f"""WITH {b.CUR}, {b.ACT}
    SELECT filename, tv, participant_id, NULL AS activity FROM cur
    UNION ALL SELECT audio_file, CASE WHEN activity = 'watching tv' THEN 1 ELSE 0 END, NULL, activity FROM act""",
)
def _(spark, sf):
    other = curate.rename(curate.binary_activity(b.activities(spark, sf)), {"audio_file": "filename"})
    return curate.union_all(b.curated(spark, sf), other).select("filename", "tv", "participant_id", "activity")


@query(
    "u2_difference",
    f"WITH {b.CUR} SELECT filename, tv FROM cur WHERE filename NOT IN (SELECT filename FROM cur WHERE participant_id % 4 = 1)",
)
def _(spark, sf):
    clips = b.curated(spark, sf)
    return curate.difference(clips, clips.filter(F.col("participant_id") % 4 == 1), "filename").select("filename", "tv")


@query(
    "curation_profile",
    f"""WITH {b.CUR}, ranked AS (
      SELECT *, row_number() OVER (PARTITION BY tv ORDER BY md5(concat_ws(':', '42', filename)), filename) AS r FROM cur),
    quota AS (SELECT least(count(*) FILTER (tv = 0), count(*) FILTER (tv = 1)) AS q FROM cur)
    SELECT tv, count(*) AS records, count(DISTINCT participant_id) AS participants, CAST(sum(tv) AS BIGINT) AS positives
    FROM ranked, quota WHERE r <= q GROUP BY tv""",
)
def _(spark, sf):
    return jobs.curation_profile(b.annotations(spark, sf), b.ORDER)
