"""Queries for scans and sinks: tables are written below the shared folder and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.functions import labels
from cliptide.plans import bindings as b
from cliptide.plans.queries_sample import ranked
from cliptide.plans.queries_sequence import PCM, pcm_chunks
from cliptide.plans.registry import query
from cliptide.session import scratch_path
from cliptide.sources import files, sinks, tables


@query("s1_csv_scan", f"WITH {b.ACT} SELECT audio_file, activity FROM act")
def _(spark, sf):
    path = scratch_path(spark, "activities")
    sinks.write_csv(b.activities(spark, sf), path)
    return tables.read_csv(spark, path, tables.ACTIVITIES)


@query("s1_annotation_scan", f"WITH {b.ANN} SELECT filename, tv, problems, coder, ord1, ord2 FROM clean")
def _(spark, sf):
    from cliptide.operators import curate

    path = scratch_path(spark, "annotations")
    written = b.annotations(spark, sf)
    sinks.write_csv(written, path)
    text = tables.read_annotations(spark, path, written.columns)
    lowered = curate.clean_flags(curate.lower_columns(text), ["tv", "problems"])
    return lowered.select(
        "filename", "tv", "problems", F.col("coder").cast("int").alias("coder"),
        *[F.col(c).cast("bigint").alias(c) for c in ("ord1", "ord2")],
    )


@query("s2_file_listing")
def _(spark, sf):
    listed = files.list_files(spark, sf, "*.parquet")
    return listed.select(labels.stem(F.col("path")).alias("stem"), "length")


WAV = f"{PCM}, clip AS (SELECT clip_id, chunk_idx, count(*) AS n FROM chunk GROUP BY 1, 2)"


def _wav_files(spark, sf):
    """One encoded clip per chunk of 16 samples; some are cut short, some are no audio at all."""
    named = pcm_chunks(spark, sf).withColumn("path", F.format_string("clips/%d-%d.wav", "clip_id", "chunk_idx"))
    encoded = files.encode_wav(named, 8000)
    return encoded.select("path", "clip_id", "chunk_idx", "content")


def _damaged(wavs):
    kind = F.col("clip_id") % 10
    content = F.when(kind == 3, F.substr("content", F.lit(1), F.lit(50))).when(
        kind == 7, F.encode("path", "utf-8")
    ).otherwise(F.col("content"))
    return wavs.select("path", content.alias("content"))


@query(
    "s3_audio_ingest",
    f"""WITH {WAV}, named AS (SELECT *, concat('clips/', clip_id, '-', chunk_idx, '.wav') AS path FROM chunk)
    SELECT path, 8000 AS sr, 1 AS channels, CAST(i // 8 AS INTEGER) AS part, CAST(i % 8 AS INTEGER) AS i, s / 32768 AS v FROM named""",
)
def _(spark, sf):
    decoded = files.good_records(files.decode_wav(_wav_files(spark, sf), chunk=8))
    cells = decoded.select("path", "sr", "channels", F.col("chunk_idx").alias("part"), F.posexplode("samples").alias("i", "v"))
    return cells.withColumn("v", F.col("v").cast("double"))


@query(
    "s4_feature_ingest",
    """WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT concat('features/', vec_id, '.npy') AS path, CAST(i // 16 AS INTEGER) AS frame, CAST(i % 16 AS INTEGER) AS i, v FROM cells""",
)
def _(spark, sf):
    named = b.table(spark, sf, "embeddings").select(
        F.format_string("features/%d.npy", "vec_id").alias("path"),
        F.transform(F.sequence(F.lit(0), F.lit(3)), lambda t: F.slice("embedding", t * 16 + 1, F.lit(16))).alias("frames"),
    )
    frames = files.good_records(files.decode_npy(files.encode_npy(named, "frames")))
    cells = frames.select("path", "frame", F.posexplode("embedding").alias("i", "v"))
    return cells.withColumn("v", F.col("v").cast("double"))


def _manifest(spark, sf):
    from cliptide.operators import sample

    return sample.group_split(b.settled_curated(spark, sf)).select("filename", "tv", "participant_id", "split")


@query(
    "s5_split_scan",
    f"""WITH {b.CUR}, groups AS (SELECT DISTINCT participant_id FROM cur), {ranked('groups', key='participant_id')},
    total AS (SELECT count(*) AS n FROM groups), parts AS (SELECT participant_id FROM ranked, total
      WHERE r > n - ceil(round(n * 0.3, 9)) AND r <= n - ceil(ceil(round(n * 0.3, 9)) / 2))
    SELECT filename, tv, 'val' AS split FROM cur WHERE participant_id IN (SELECT participant_id FROM parts)""",
)
def _(spark, sf):
    path = scratch_path(spark, "manifest")
    sinks.write_features(_manifest(spark, sf), path, ["split"])
    return tables.split_rows(spark.read.parquet(path), "val").select("filename", "tv", "split")


@query(
    "s6_fold_scan",
    f"""WITH {b.CUR} SELECT filename, tv, CAST(participant_id % 4 AS INTEGER) AS fold_1, CAST(participant_id % 3 AS INTEGER) AS fold_2
    FROM cur WHERE participant_id % 4 = 2 AND participant_id % 3 = 1""",
)
def _(spark, sf):
    path = scratch_path(spark, "folds")
    folded = b.curated(spark, sf).select(
        "filename", "tv", (F.col("participant_id") % 4).alias("fold_1"), (F.col("participant_id") % 3).alias("fold_2")
    )
    sinks.write_features(folded, path, ["fold_1", "fold_2"])
    return tables.fold_rows(spark, path, 2, 1)


@query("s7_vocabulary", f'WITH {b.VOC} SELECT "index", mid, display_name FROM voc')
def _(spark, sf):
    path = scratch_path(spark, "vocabulary")
    sinks.write_csv(b.vocabulary(spark, sf), path)
    return tables.read_vocabulary(spark, path)


FEATURES = """SELECT vec_id, label, CAST(label % 3 AS INTEGER) AS dataset,
  round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings"""


def _features(spark, sf):
    first = F.round(F.get("embedding", F.lit(0)).cast("double"), 6)
    return b.table(spark, sf, "embeddings").select("vec_id", "label", first.alias("first"), (F.col("label") % 3).alias("dataset"))


@query("s8_feature_sink", FEATURES)
def _(spark, sf):
    path = scratch_path(spark, "features")
    sinks.write_features(_features(spark, sf), path)
    return spark.read.parquet(path)


@query("s9_materialised", FEATURES)
def _(spark, sf):
    path = scratch_path(spark, "materialised")
    sinks.materialised(spark, path, lambda: _features(spark, sf))
    return sinks.materialised(spark, path, lambda: _features(spark, sf).limit(0))


@query("s9_materialised_by_fingerprint", FEATURES)
def _(spark, sf):
    """Computed for other parameters first, then for these; the second request for these computes nothing."""
    path, inputs = scratch_path(spark, "versions"), [b.table(spark, sf, "embeddings")]
    sinks.materialised_for(spark, path, inputs, lambda: _features(spark, sf).limit(0), {"rows": 0})
    sinks.materialised_for(spark, path, inputs, lambda: _features(spark, sf), {"rows": "all"})
    return sinks.materialised_for(spark, path, inputs, lambda: _features(spark, sf).limit(0), {"rows": "all"})


@query("s10_csv_sink", FEATURES)
def _(spark, sf):
    path = scratch_path(spark, "results")
    sinks.write_csv(_features(spark, sf), path)
    return tables.read_csv(spark, path, "vec_id bigint, label int, first double, dataset int")


@query("s11_json_sink", FEATURES)
def _(spark, sf):
    path = scratch_path(spark, "metrics")
    sinks.write_json(_features(spark, sf), path)
    return spark.read.schema("vec_id bigint, label int, first double, dataset int").json(path)


@query(
    "s12_text_sink",
    """SELECT concat('clip-', CAST(vec_id AS VARCHAR), '_', CAST(label AS VARCHAR), ': ', CAST(vec_id % 7 AS VARCHAR)) AS line
    FROM embeddings""",
)
def _(spark, sf):
    path = scratch_path(spark, "lines")
    stem = F.concat(F.lit("clip-"), F.col("vec_id").cast("string"))
    line = sinks.chunk_line(stem, F.col("label"), F.col("vec_id") % 7)
    lines = b.table(spark, sf, "embeddings").withColumn("line", line)
    sinks.append_text(lines.filter("label < 5"), path)
    sinks.append_text(lines.filter("label >= 5"), path)
    return spark.read.text(path).withColumnRenamed("value", "line")


@query(
    "s12_append_batches",
    """SELECT concat('labels-', CAST(label % 3 AS VARCHAR)) AS batch,
    concat('clip-', CAST(vec_id AS VARCHAR), '_', CAST(label AS VARCHAR), ': ', CAST(vec_id % 7 AS VARCHAR)) AS line FROM embeddings""",
)
def _(spark, sf):
    """Three batches of lines, the second of them appended twice."""
    path = scratch_path(spark, "batches")
    stem = F.concat(F.lit("clip-"), F.col("vec_id").cast("string"))
    lines = b.table(spark, sf, "embeddings").withColumn("line", sinks.chunk_line(stem, F.col("label"), F.col("vec_id") % 7))
    for part in (0, 1, 1, 2):
        sinks.append_batch(lines.filter(F.col("label") % 3 == part), path, f"labels-{part}")
    return sinks.read_batches(spark, path).withColumnRenamed("value", "line")


@query(
    "s13_bad_records",
    f"""WITH {WAV} SELECT concat('clips/', clip_id, '-', chunk_idx, '.wav') AS path, clip_id % 10 NOT IN (3, 7) AS decoded FROM clip""",
)
def _(spark, sf):
    read = files.decode_wav(_damaged(_wav_files(spark, sf)))
    good = files.good_records(read).select("path", F.lit(True).alias("decoded"))
    return good.unionByName(files.bad_records(read).select("path", F.lit(False).alias("decoded")))


@query(
    "s14_clip_metadata",
    f"""WITH {WAV} SELECT concat('clips/', clip_id, '-', chunk_idx, '.wav') AS path, 8000 AS sr, 1 AS channels, n AS n_samples,
      round(n / 8000, 6) AS duration FROM clip""",
)
def _(spark, sf):
    described = files.duration(files.wav_metadata(_wav_files(spark, sf)))
    return described.select("path", "sr", "channels", "n_samples", F.round("duration", 6).alias("duration"))
