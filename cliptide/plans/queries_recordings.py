"""Queries for long recordings in blocks, with blocks so small that frames and filters cross their borders."""

from __future__ import annotations

from math import ceil, gcd

from pyspark.sql import functions as F

from cliptide.operators import recordings, sequence
from cliptide.plans import bindings as b
from cliptide.plans.queries_spectral import DFT
from cliptide.plans.registry import query


@query(
    "x1_framed_dft_blocks",
    f"WITH {DFT} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(magnitude, 6) AS magnitude FROM dft",
)
def _(spark, sf):
    spectra = recordings.long_magnitudes(b.signal(spark, sf), 24, 16, 8, 32)
    rows = spectra.select("clip_id", "frame", F.posexplode("magnitude").alias("bin", "magnitude"))
    return rows.withColumn("magnitude", F.round("magnitude", 6))


def _sinc_sql(source: int, target: int, zeros: int, head: str) -> str:
    """A direct sum over all samples that the tapered sinc reaches, of ``sig`` (clip_id, pos, sample)."""
    up, down = target // gcd(source, target), source // gcd(source, target)
    cut = min(1.0, up / down)
    half = zeros / cut
    reach = ceil(half)
    return f"""{head}, n AS (SELECT clip_id, max(pos) + 1 AS n FROM sig GROUP BY 1),
    grid AS (SELECT clip_id, unnest(range((n * {up} + {down - 1}) // {down})) AS grid FROM n),
    taps AS (SELECT clip_id, grid, unnest(range(grid * {down} // {up} - {reach - 1}, grid * {down} // {up} + {reach + 1})) AS pos FROM grid),
    met AS (SELECT clip_id, grid, sample, grid * {down} / {up} - pos AS u FROM taps JOIN sig USING (clip_id, pos)),
    weighed AS (SELECT *, CASE WHEN abs(u) >= {half!r} THEN 0 ELSE 0.42 + 0.5 * cos(pi() * u / {half!r}) + 0.08 * cos(2 * pi() * u / {half!r}) END
      * CASE WHEN u = 0 THEN 1 ELSE sin(pi() * {cut!r} * u) / (pi() * {cut!r} * u) END * {cut!r} AS w FROM met)
    SELECT clip_id, grid, round(sum(sample * w), 6) + 0.0::DOUBLE AS sample FROM weighed GROUP BY 1, 2"""


def _rounded(df):
    return df.withColumn("sample", F.round("sample", 6) + F.lit(0.0))


@query("x12_resample_sinc_up", _sinc_sql(5, 8, 8, f"WITH {b.SIG}"))
def _(spark, sf):
    return _rounded(recordings.resample_sinc_rows(b.signal(spark, sf), 5, 8, 16, 8))


@query("x12_resample_sinc_down", _sinc_sql(441, 160, 8, f"WITH {b.SIG}"))
def _(spark, sf):
    return _rounded(recordings.resample_sinc_rows(b.signal(spark, sf), 44_100, 16_000, 16, 8))


_CUT = "WITH " + b.SIG.replace("sig AS", "every AS") + """,
sig AS (SELECT clip_id, pos, sample FROM (SELECT *, count(*) OVER (PARTITION BY clip_id, pos // 30) AS held FROM every) WHERE held = 30 OR pos < 30)"""


@query("x12_resample_sinc_chunks", _sinc_sql(8, 5, 8, _CUT))
def _(spark, sf):
    """Full chunks of 30 samples, as the ingest of long files gives them; a short clip is one short chunk."""
    rows = b.signal(spark, sf)
    full = sequence.chunks(rows, 30)
    short = rows.groupBy("clip_id").agg(F.max("pos").alias("_top"), sequence.in_order("pos", "sample").alias("samples")).filter("_top < 29")
    both = full.select("clip_id", "chunk_idx", "samples").unionByName(short.select("clip_id", F.lit(0).cast("long").alias("chunk_idx"), "samples"))
    made = recordings.resample_chunks(both, 8, 5, 30, 8)
    spread = made.select("clip_id", "first", F.posexplode("samples").alias("_i", "sample"))
    return _rounded(spread.select("clip_id", (F.col("first") + F.col("_i")).alias("grid"), "sample"))


_WAVES = f"WITH {b.WAVES}, sig AS (SELECT clip_id, generate_subscripts(samples, 1) - 1 AS pos, unnest(samples) AS sample FROM waves)"


@query("x12_resample_sinc_arrays", _sinc_sql(5, 8, 16, _WAVES))
def _(spark, sf):
    made = recordings.resample_sinc_array(F.col("samples"), 5, 8, 16)
    out = b.waves(spark, sf).select("clip_id", F.posexplode(made).alias("grid", "sample"))
    return _rounded(out.withColumn("grid", F.col("grid").cast("long")))
