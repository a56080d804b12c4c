"""Queries for chunks, frames and sequence shaping."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.functions import arrays
from cliptide.operators import sequence
from cliptide.operators.exact import running
from cliptide.plans import bindings as b
from cliptide.plans.registry import query


def _exploded(df, keys, column="samples", idx="i", value="v"):
    return df.select(*keys, F.posexplode(column).alias(idx, value)).withColumn(value, F.col(value).cast("double"))


def _cells(df, keys, column="frames"):
    frames = df.select(*keys, F.posexplode(column).alias("t", "_f"))
    return _exploded(frames, [*keys, "t"], "_f")


EMB = """emb AS (
  SELECT vec_id, label, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"""


@query(
    "p14_argmax",
    f"""WITH {EMB}, tops AS (SELECT vec_id, max(v) AS m FROM emb GROUP BY vec_id)
    SELECT e.vec_id, CAST(min(i) AS INTEGER) AS class_idx FROM emb e JOIN tops t ON e.vec_id = t.vec_id AND e.v = t.m GROUP BY 1""",
)
def _(spark, sf):
    return b.table(spark, sf, "embeddings").select("vec_id", arrays.argmax(F.col("embedding")).alias("class_idx"))


@query(
    "p15_one_hot",
    "SELECT vec_id, CAST(c.i AS INTEGER) AS i, CAST(c.i = label AS INTEGER) AS v FROM embeddings, range(10) c(i)",
)
def _(spark, sf):
    coded = b.table(spark, sf, "embeddings").select("vec_id", arrays.one_hot(F.col("label"), 10).alias("hot"))
    return coded.select("vec_id", F.posexplode("hot").alias("i", "v"))


PCM = b.SIG + """,
pcm AS (SELECT clip_id, pos // 16 AS chunk_idx, pos % 16 AS i, CAST(floor(sample * 50) AS INTEGER) AS s FROM sig),
whole AS (SELECT clip_id, chunk_idx FROM pcm GROUP BY 1, 2 HAVING count(*) = 16),
chunk AS (SELECT p.* FROM pcm p JOIN whole w ON p.clip_id = w.clip_id AND p.chunk_idx = w.chunk_idx)"""


def pcm_chunks(spark, sf):
    """(clip_id, chunk_idx, samples) with 16 integer samples per chunk; loud ones may go beyond 16 bits."""
    rows = b.signal(spark, sf).withColumn("sample", F.floor(F.col("sample") * 50).cast("int"))
    return sequence.chunks(rows, 16)


@query("p16_pcm_to_unit", f"WITH {PCM} SELECT clip_id, chunk_idx, CAST(i AS INTEGER) AS i, s / 32768 AS v FROM chunk")
def _(spark, sf):
    scaled = pcm_chunks(spark, sf).withColumn("samples", arrays.pcm_to_unit(F.col("samples")))
    return _exploded(scaled, ["clip_id", "chunk_idx"])


@query(
    "p17_downmix",
    f"""WITH {EMB} SELECT l.vec_id, CAST(l.i AS INTEGER) AS i, (l.v + r.v) / 2 AS v
    FROM emb l JOIN emb r ON l.vec_id = r.vec_id AND l.i + r.i = 63""",
)
def _(spark, sf):
    left, right = F.col("embedding"), F.reverse("embedding")
    mixed = b.table(spark, sf, "embeddings").select("vec_id", arrays.downmix(left, right).alias("samples"))
    return _exploded(mixed, ["vec_id"])


@query(
    "p19_features_and_label",
    f"WITH {EMB} SELECT vec_id, CAST(i AS INTEGER) AS i, v, CAST(label AS INTEGER) AS label FROM emb",
)
def _(spark, sf):
    row = F.concat("embedding", F.array(F.col("label").cast("float")))
    rows = b.table(spark, sf, "embeddings").select("vec_id", row.alias("row"))
    split = rows.select(
        "vec_id", arrays.features_of(F.col("row")).alias("samples"), arrays.label_of(F.col("row")).cast("int").alias("label")
    )
    return _exploded(split, ["vec_id", "label"])


@query(
    "p20_label_frames",
    f"""WITH {b.SEQ}, firsts AS (SELECT seq_id, min_by(label, pos) AS label FROM seq GROUP BY 1)
    SELECT s.seq_id, CAST(s.pos AS INTEGER) AS frame, f.label, round(CAST(s.embedding[1] AS DOUBLE), 6) AS head
    FROM seq s JOIN firsts f ON s.seq_id = f.seq_id""",
)
def _(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf), "seq_id", keep=["label"])
    frames = sequence.label_frames(whole)
    return frames.select("seq_id", "frame", "label", F.round(F.get("embedding", F.lit(0)).cast("double"), 6).alias("head"))


@query(
    "w1_chunks",
    f"""WITH {b.SIG}, c AS (SELECT clip_id, pos // 16 AS chunk_idx, pos % 16 AS i, sample AS v FROM sig),
    whole AS (SELECT clip_id, chunk_idx FROM c GROUP BY 1, 2 HAVING count(*) = 16)
    SELECT c.clip_id, c.chunk_idx, CAST(i AS INTEGER) AS i, v FROM c
    JOIN whole w ON c.clip_id = w.clip_id AND c.chunk_idx = w.chunk_idx""",
)
def _(spark, sf):
    return _exploded(sequence.chunks(b.signal(spark, sf), 16), ["clip_id", "chunk_idx"])


@query(
    "w1_chunk_arrays",
    f"""WITH {b.WAVES}, cut AS (SELECT clip_id, unnest(range(len(samples) // 16)) AS chunk_idx, samples FROM waves)
    SELECT clip_id, CAST(chunk_idx AS INTEGER) AS chunk_idx, round(list_sum(samples[chunk_idx * 16 + 1:chunk_idx * 16 + 16]), 6) AS v
    FROM cut""",
)
def _(spark, sf):
    cut = sequence.chunk_arrays(b.waves(spark, sf).drop("label"), 16)
    return cut.select("clip_id", "chunk_idx", F.round(arrays.total(F.col("samples")), 6).alias("v"))


def framed_sql(length: int, hop: int, source: str = "sig", name: str = "fr") -> str:
    return f"""{name}_all AS (
      SELECT clip_id, f.frame, pos - f.frame * {hop} AS i, sample AS v FROM {source},
        LATERAL (SELECT unnest(generate_series(CAST(greatest(ceil((pos - {length - 1}) / {hop}), 0) AS BIGINT),
                                               CAST(floor(pos / {hop}) AS BIGINT))) AS frame) f),
    {name}_full AS (SELECT clip_id, frame FROM {name}_all GROUP BY 1, 2 HAVING count(*) = {length}),
    {name} AS (SELECT a.* FROM {name}_all a JOIN {name}_full b ON a.clip_id = b.clip_id AND a.frame = b.frame)"""


@query(
    "w2_tumbling_frames",
    f"WITH {b.SIG}, {framed_sql(10, 10)} SELECT clip_id, frame, CAST(i AS INTEGER) AS i, v FROM fr",
)
def _(spark, sf):
    return _exploded(sequence.frame_rows(b.signal(spark, sf), 10, 10), ["clip_id", "frame"])


@query(
    "w3_sliding_frames",
    f"WITH {b.SIG}, {framed_sql(16, 6)} SELECT clip_id, frame, CAST(i AS INTEGER) AS i, v FROM fr",
)
def _(spark, sf):
    return _exploded(sequence.frame_rows(b.signal(spark, sf), 16, 6), ["clip_id", "frame"])


@query(
    "w3_frame_arrays",
    f"""WITH {b.WAVES}, cut AS (
      SELECT clip_id, unnest(range(CASE WHEN len(samples) < 16 THEN 0 ELSE (len(samples) - 16) // 6 + 1 END)) AS frame, samples FROM waves)
    SELECT clip_id, CAST(frame AS INTEGER) AS frame, round(list_sum(samples[frame * 6 + 1:frame * 6 + 16]), 6) AS v FROM cut""",
)
def _(spark, sf):
    cut = sequence.frame_arrays(b.waves(spark, sf).drop("label"), 16, 6)
    return cut.select("clip_id", "frame", F.round(arrays.total(F.col("samples")), 6).alias("v"))


@query(
    "w4_running_sum",
    f"""WITH {b.SIG} SELECT clip_id, pos, round(sum(sample) OVER (PARTITION BY clip_id ORDER BY pos
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 6) AS running FROM sig""",
)
def _(spark, sf):
    scanned = running(b.signal(spark, sf), "clip_id", "pos", "sample", block=32)
    return scanned.select("clip_id", "pos", F.round("running", 6).alias("running"))


def _padded_sql(size: str) -> str:
    return f"""WITH {b.WAVES}, sized AS (SELECT clip_id, samples, CAST({size} AS BIGINT) AS n FROM waves)
    SELECT clip_id, CAST(i AS INTEGER) AS i, coalesce(samples[i + 1], 0.0) AS v
    FROM (SELECT clip_id, samples, unnest(range(n)) AS i FROM sized)"""


@query("w5_pad_to_patches", _padded_sql("20 + ceil(greatest(len(samples) - 20, 0) / 16) * 16"))
def _(spark, sf):
    padded = b.waves(spark, sf).withColumn("samples", arrays.pad_to_patches(F.col("samples"), 20, 16))
    return _exploded(padded, ["clip_id"])


@query("w6_fit_length", _padded_sql("30"))
def _(spark, sf):
    fixed = b.waves(spark, sf).withColumn("samples", arrays.fit_length(F.col("samples"), 30))
    return _exploded(fixed, ["clip_id"])


def _grid_sql(length: str, size: int = 62) -> str:
    return f"""WITH {b.seq_sql(size)}, cells AS (
      SELECT seq_id, pos, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM seq),
    grid AS (SELECT seq_id, t, i FROM (SELECT DISTINCT seq_id FROM seq), (SELECT unnest(range({length})) AS t), range(64) r(i))
    SELECT g.seq_id, CAST(g.t AS INTEGER) AS t, CAST(g.i AS INTEGER) AS i, coalesce(c.v, 0.0) AS v
    FROM grid g LEFT JOIN cells c ON g.seq_id = c.seq_id AND g.t = c.pos AND g.i = c.i"""


@query("w7_pad_sequences", _grid_sql("31"))
def _(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf), "seq_id", length=31)
    return _cells(sequence.pad_sequences(whole, 64, 31), ["seq_id"])


@query("w8_pad_to_longest", _grid_sql("(SELECT max(pos) + 1 FROM seq)", 62))
def _(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf), "seq_id")
    return _cells(sequence.pad_to_longest(whole, 64), ["seq_id"])


@query(
    "w9_rechunk",
    """WITH flat AS (SELECT row_number() OVER (ORDER BY label, vec_id) - 1 AS idx, label, embedding FROM embeddings),
    cut AS (SELECT idx // 62 AS seq_id, idx % 62 AS pos, label, embedding FROM flat),
    firsts AS (SELECT seq_id, min_by(label, pos) AS label FROM cut GROUP BY 1)
    SELECT f.seq_id, f.label, CAST(t.t AS INTEGER) AS t, coalesce(CAST(c.embedding[1] AS DOUBLE), 0.0) AS first,
      coalesce(CAST(c.embedding[64] AS DOUBLE), 0.0) AS last
    FROM firsts f CROSS JOIN range(62) t(t) LEFT JOIN cut c ON f.seq_id = c.seq_id AND c.pos = t.t""",
)
def _(spark, sf):
    whole = sequence.rechunk(b.table(spark, sf, "embeddings"), ["label", "vec_id"], 64)
    frames = whole.select("seq_id", "label", F.posexplode("frames").alias("t", "_f"))
    at = lambda i: F.get("_f", F.lit(i)).cast("double")
    return frames.select("seq_id", "label", "t", at(0).alias("first"), at(63).alias("last"))


@query(
    "w10_pool_pairs",
    f"""WITH {b.CELLS} SELECT seq_id, CAST(pos // 2 AS INTEGER) AS t, CAST(i AS INTEGER) AS i, round(avg(v), 6) AS v
    FROM cells GROUP BY 1, 2, 3 HAVING count(*) = 2""",
)
def _(spark, sf):
    pooled = sequence.pool_pairs(sequence.sequences(b.numbered(spark, sf), "seq_id"))
    return _cells(pooled, ["seq_id"]).withColumn("v", F.round("v", 6))
