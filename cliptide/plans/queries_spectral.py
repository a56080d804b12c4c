"""Queries for signal and spectral features, over small frames so that SQL can check them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cliptide.functions import arrays, transforms
from cliptide.operators import evaluate, sequence, spectral
from cliptide.plans import bindings as b
from cliptide.plans.queries_sequence import framed_sql
from cliptide.plans.registry import query

DFT = f"""{b.SIG}, {framed_sql(16, 8)},
basis AS (SELECT k.k, n.n, (0.5 - 0.5 * cos(2 * pi() * k.k / 16)) * cos(2 * pi() * k.k * n.n / 32) AS re,
  (0.5 - 0.5 * cos(2 * pi() * k.k / 16)) * sin(2 * pi() * k.k * n.n / 32) AS im FROM range(16) k(k), range(17) n(n)),
dft AS (SELECT clip_id, frame, n AS bin, sqrt(sum(v * re) ^ 2 + sum(v * im) ^ 2) AS magnitude
  FROM fr JOIN basis ON i = k GROUP BY 1, 2, 3)"""


def _dft(spark, sf):
    frames = sequence.frame_rows(b.signal(spark, sf), 16, 8)
    magnitude = transforms.dft_magnitude(16, 32)("samples")
    return frames.select("clip_id", "frame", F.posexplode(magnitude).alias("bin", "magnitude"))


@query(
    "x1_framed_dft",
    f"WITH {DFT} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(magnitude, 6) AS magnitude FROM dft",
)
def _(spark, sf):
    return _dft(spark, sf).withColumn("magnitude", F.round("magnitude", 6))


@query(
    "x1_framed_dft_rows",
    f"WITH {DFT} SELECT clip_id, frame, CAST(bin AS INTEGER) AS bin, round(magnitude, 6) AS magnitude FROM dft",
)
def _(spark, sf):
    frames = sequence.frame_rows(b.signal(spark, sf), 16, 8)
    rows = frames.select("clip_id", "frame", F.posexplode("samples").alias("i", "v"))
    return spectral.dft_rows(rows, 16, 32, ["clip_id", "frame"], "i", "v").withColumn("magnitude", F.round("magnitude", 6))


WHOLE = f"""{b.SIG}, cut AS (SELECT clip_id, pos // 48 AS chunk_idx, pos % 48 AS i, sample AS v FROM sig),
entire AS (SELECT clip_id, chunk_idx FROM cut GROUP BY 1, 2 HAVING count(*) = 48),
ch AS (SELECT c.* FROM cut c JOIN entire f ON c.clip_id = f.clip_id AND c.chunk_idx = f.chunk_idx)"""

POWER = f"""{WHOLE},
placed AS (SELECT clip_id, chunk_idx, t.t, i + 16 - t.t * 8 AS k, v FROM ch, range(7) t(t)
  WHERE i + 16 - t.t * 8 BETWEEN 0 AND 31),
bins AS (SELECT clip_id, chunk_idx, t, n.n AS bin,
  sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 32)) * cos(2 * pi() * k * n.n / 32)) AS re,
  sum(v * (0.5 - 0.5 * cos(2 * pi() * k / 32)) * sin(2 * pi() * k * n.n / 32)) AS im
  FROM placed, range(17) n(n) GROUP BY 1, 2, 3, 4),
spec AS (SELECT clip_id, chunk_idx, bin, sum(re * re + im * im) / 32 AS power FROM bins GROUP BY 1, 2, 3)"""

SHARE = f"""{POWER}, segs AS (SELECT clip_id, chunk_idx, bin // 2 AS seg, sum(power) AS s FROM spec WHERE bin < 16 GROUP BY 1, 2, 3),
shares AS (SELECT clip_id, chunk_idx, seg, s / sum(s) OVER (PARTITION BY clip_id, chunk_idx) AS share FROM segs)"""


def _power(spark, sf):
    chunks = sequence.chunks(b.signal(spark, sf), 48)
    spec = spectral.power_spectrum(chunks, 32, 8)
    return spec.select("clip_id", "chunk_idx", F.posexplode("power").alias("bin", "power"))


CHUNK = ["clip_id", "chunk_idx"]


def _shares(spark, sf):
    return spectral.segment_shares(_power(spark, sf), CHUNK, "bin", "power", 2, 17)


@query(
    "x2_summed_power",
    f"WITH {POWER} SELECT clip_id, chunk_idx, CAST(bin AS INTEGER) AS bin, round(power, 6) AS power FROM spec",
)
def _(spark, sf):
    return _power(spark, sf).withColumn("power", F.round("power", 6))


_MEL = """mels AS (SELECT 1127.0 * ln(1 + 125.0 / 700) AS lo, 1127.0 * ln(1 + 7500.0 / 700) AS hi),
tri AS (SELECT n.n, d.d AS band, (1127.0 * ln(1 + n.n * 500.0 / 700) - (lo + (hi - lo) / 5 * d.d)) / ((hi - lo) / 5) AS up,
  ((lo + (hi - lo) / 5 * (d.d + 2)) - 1127.0 * ln(1 + n.n * 500.0 / 700)) / ((hi - lo) / 5) AS down
  FROM mels, range(1, 17) n(n), range(4) d(d)),
weights AS (SELECT n, band, least(up, down) AS w FROM tri WHERE least(up, down) > 0),
mel AS (SELECT clip_id, frame, band, sum(magnitude * w) AS mel FROM dft JOIN weights ON bin = n GROUP BY 1, 2, 3)"""


@query(
    "x3_mel_bands",
    f"WITH {DFT}, {_MEL} SELECT clip_id, frame, CAST(band AS INTEGER) AS band, round(mel, 6) AS mel FROM mel",
)
def _(spark, sf):
    bands = spectral.mel_bands(_dft(spark, sf), ["clip_id", "frame"], 17, bands=4)
    return bands.withColumn("mel", F.round("mel", 6))


def _log_mel(spark, sf):
    frames = sequence.frame_rows(b.signal(spark, sf), 16, 8)
    magnitude = transforms.dft_magnitude(16, 32)("samples")
    spectra = frames.select("clip_id", "frame", magnitude.alias("magnitude"))
    mel = F.transform(spectral.mel_arrays(F.col("magnitude"), 17, bands=4), lambda v: spectral.stabilised_log(v))
    return spectra.select("clip_id", "frame", mel.alias("mel"))


@query(
    "x4_log_mel",
    f"WITH {DFT}, {_MEL} SELECT clip_id, frame, CAST(band AS INTEGER) AS band, round(ln(mel + 0.01), 6) AS v FROM mel",
)
def _(spark, sf):
    cells = _log_mel(spark, sf).select("clip_id", "frame", F.posexplode("mel").alias("band", "v"))
    return cells.withColumn("v", F.round("v", 6))


@query(
    "x5_patches",
    f"""WITH {DFT}, {_MEL}, logs AS (SELECT clip_id, frame, sum(ln(mel + 0.01)) AS v FROM mel GROUP BY 1, 2),
    grouped AS (SELECT *, frame // 3 AS patch FROM logs),
    entire AS (SELECT clip_id, patch FROM grouped GROUP BY 1, 2 HAVING count(*) = 3)
    SELECT g.clip_id, g.patch, CAST(g.frame % 3 AS INTEGER) AS t, round(g.v, 6) AS v
    FROM grouped g JOIN entire f ON g.clip_id = f.clip_id AND g.patch = f.patch""",
)
def _(spark, sf):
    cut = spectral.patches(_log_mel(spark, sf), ["clip_id"], size=3, hop=3)
    rows = cut.select("clip_id", "patch", F.posexplode("frames").alias("t", "_f"))
    return rows.select("clip_id", "patch", "t", F.round(arrays.total(F.col("_f")), 6).alias("v"))


@query(
    "j6_linear_map",
    f"""WITH {b.SCORES} SELECT clip, frame, CAST(o.o AS INTEGER) AS out_idx,
      round(sum(x * ((class_idx + o.o) % 5 - 2)), 6) AS value
    FROM raw, range(3) o(o) GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    matrix = np.add.outer(np.arange(64), np.arange(3)) % 5 - 2.0
    rows = b.table(spark, sf, "embeddings").select(
        F.col("label").alias("clip"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("i", "v")
    )
    rows = rows.withColumn("v", F.col("v").cast("double"))
    mapped = spectral.linear_map(rows, matrix, ["clip", "frame"], "i", "v")
    return mapped.withColumn("value", F.round("value", 6))


@query(
    "j6_tiled_map",
    """WITH lines AS (SELECT l_suppkey, l_orderkey % 4096 AS i, l_quantity AS v FROM lineitem WHERE l_linenumber = 1)
    SELECT l_suppkey, CAST(o.o AS INTEGER) AS out_idx, round(sum(v * ((i * 31 + o.o * 17) % 101 - 50) / 50), 6) + 0.0::DOUBLE AS value
    FROM lines, range(1024) o(o) WHERE (i * 31 + o.o * 17) % 101 <> 50 GROUP BY 1, 2""",
)
def _(spark, sf):
    """4,096 inputs and 1,024 outputs: the first line of every order, by supplier."""
    matrix = ((np.arange(4096)[:, None] * 31 + np.arange(1024)[None, :] * 17) % 101 - 50) / 50
    lines = b.table(spark, sf, "lineitem").filter("l_linenumber = 1").select("l_suppkey", (F.col("l_orderkey") % 4096).alias("i"), F.col("l_quantity").alias("v"))
    mapped = spectral.linear_map(lines, matrix, ["l_suppkey"], "i", "v")
    return mapped.withColumn("value", F.round("value", 6) + F.lit(0.0))


@query(
    "w11_segment_shares",
    f"WITH {SHARE} SELECT clip_id, chunk_idx, CAST(seg AS BIGINT) AS seg, round(share, 6) AS share FROM shares",
)
def _(spark, sf):
    return _shares(spark, sf).withColumn("share", F.round("share", 6))


@query(
    "x9_low_power",
    f"WITH {SHARE} SELECT clip_id, chunk_idx, CAST(seg AS BIGINT) AS seg, round(share * 100, 6) AS share FROM shares WHERE seg < 5",
)
def _(spark, sf):
    return spectral.low_power(_shares(spark, sf), 5).withColumn("share", F.round("share", 6))


@query(
    "x7_linearity",
    f"""WITH {SHARE}, cdf AS (SELECT clip_id, chunk_idx, CAST(seg AS DOUBLE) AS y, sum(share) OVER (
        PARTITION BY clip_id, chunk_idx ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS x FROM shares),
    m AS (SELECT clip_id, chunk_idx, covar_pop(x, y) AS xy, covar_pop(x * x, y) AS x2y, covar_pop(x, x * x) AS xx2,
      var_pop(x) AS vx, var_pop(x * x) AS vx2, var_pop(y) AS vy FROM cdf GROUP BY 1, 2)
    SELECT clip_id, chunk_idx, round(xy / sqrt(vx * vy), 6) AS rho,
      round((x2y * vx - xy * xx2) / (vx2 * vx - xx2 * xx2) * 8 / 7, 4) AS q FROM m""",
)
def _(spark, sf):
    features = spectral.linearity(_shares(spark, sf), CHUNK)
    return features.select(*CHUNK, F.round("rho", 6).alias("rho"), F.round("q", 4).alias("q"))


# Samples are cut to steps of 40, so that flat tops occur.
PEAKS = f"""{b.SIG}, steps AS (SELECT clip_id, pos, floor(sample / 40) AS v FROM sig),
edges AS (SELECT *, CASE WHEN lag(v) OVER w IS DISTINCT FROM v THEN 1 ELSE 0 END AS e FROM steps
  WINDOW w AS (PARTITION BY clip_id ORDER BY pos)),
isles AS (SELECT *, sum(e) OVER (PARTITION BY clip_id ORDER BY pos) AS g FROM edges),
runs AS (SELECT clip_id, g, min(pos) AS a, max(pos) AS z, max(v) AS v FROM isles GROUP BY 1, 2),
near AS (SELECT *, lag(v) OVER w AS before, lead(v) OVER w AS after FROM runs WINDOW w AS (PARTITION BY clip_id ORDER BY g)),
peaks AS (SELECT clip_id, (a + z) // 2 AS pos, v FROM near WHERE before < v AND after < v AND v >= 0),
strong AS (SELECT p.* FROM peaks p JOIN (SELECT clip_id, max(v) AS m FROM peaks GROUP BY 1) t ON p.clip_id = t.clip_id
  WHERE v >= 0.3 * m)"""


def _steps(spark, sf):
    return b.signal(spark, sf).select("clip_id", "pos", F.floor(F.col("sample") / 40).cast("double").alias("value"))


@query("w12_local_maxima", f"WITH {PEAKS} SELECT clip_id, CAST(pos AS BIGINT) AS pos, v AS value FROM peaks")
def _(spark, sf):
    return spectral.local_maxima(_steps(spark, sf), "clip_id", block=16)


@query("w13_strong_peaks", f"WITH {PEAKS} SELECT clip_id, CAST(pos AS BIGINT) AS pos, v AS value FROM strong")
def _(spark, sf):
    peaks = spectral.local_maxima(_steps(spark, sf), "clip_id", block=16)
    return spectral.strong_peaks(peaks, "clip_id")


@query(
    "x8_peak_features",
    f"""WITH {PEAKS}, clips AS (SELECT DISTINCT clip_id FROM sig)
    SELECT c.clip_id, count(s.pos) AS n_peak, round(avg(s.pos), 6) AS mu_peak, round(stddev_pop(s.pos), 6) AS sigma_peak
    FROM clips c LEFT JOIN strong s ON c.clip_id = s.clip_id GROUP BY 1""",
)
def _(spark, sf):
    features = spectral.peak_features(_steps(spark, sf), "clip_id")
    return features.select(
        "clip_id", "n_peak", F.round("mu_peak", 6).alias("mu_peak"), F.round("sigma_peak", 6).alias("sigma_peak")
    )


@query(
    "x8_smooth_fit",
    f"""WITH {WHOLE}, u AS (SELECT *, i - 23.5 AS u FROM ch),
    uv AS (SELECT *, u * u - 191.91666666666666 AS w FROM u),
    fit AS (SELECT clip_id, chunk_idx, avg(v) AS c, sum(u * v) / sum(u * u) AS b, sum(w * v) / sum(w * w) AS a
      FROM uv GROUP BY 1, 2)
    SELECT f.clip_id, f.chunk_idx, CAST(p.p AS INTEGER) AS i,
      round(c + b * (p.p - 23.5) + a * ((p.p - 23.5) * (p.p - 23.5) - 191.91666666666666), 6) AS fit
    FROM fit f, range(8) p(p)""",
)
def _(spark, sf):
    rows = sequence.chunks(b.signal(spark, sf), 48).select(*CHUNK, F.posexplode("samples").alias("i", "v"))
    fit = spectral.smooth_fit(rows, CHUNK, 48, "i", "v", degree=2, keep=8)
    return fit.withColumn("fit", F.round("fit", 6))


ENERGY = f"""{WHOLE}, parts AS (SELECT clip_id, chunk_idx, i // 4 AS frame, i % 4 AS k, v FROM ch),
mags AS (SELECT clip_id, chunk_idx, frame, n.n AS bin, sqrt(sum(v * cos(2 * pi() * k * n.n / 32)) ^ 2
  + sum(v * sin(2 * pi() * k * n.n / 32)) ^ 2) AS m FROM parts, range(2, 11) n(n) GROUP BY 1, 2, 3, 4),
ratios AS (SELECT clip_id, chunk_idx, frame, sum(m) FILTER (bin < 6) / sum(m) AS ratio FROM mags GROUP BY 1, 2, 3)"""


def _energy(spark, sf, operator):
    chunks = sequence.chunks(b.signal(spark, sf), 48)
    return operator(chunks, rate=320, nfft=32, frame=4, low=20, high=100, cutoff=40)


@query(
    "x6_energy_frames",
    f"WITH {ENERGY} SELECT clip_id, chunk_idx, CAST(frame AS INTEGER) AS frame, round(ratio, 6) AS ratio FROM ratios",
)
def _(spark, sf):
    return _energy(spark, sf, spectral.energy_balance_frames).withColumn("ratio", F.round("ratio", 6))


@query(
    "x6_energy_balance",
    f"""WITH {ENERGY}, stats AS (SELECT clip_id, chunk_idx, avg(ratio) AS mu, stddev_pop(ratio) AS sd FROM ratios GROUP BY 1, 2)
    SELECT r.clip_id, r.chunk_idx, round(median(ratio), 6) AS metric FROM ratios r
    JOIN stats s ON r.clip_id = s.clip_id AND r.chunk_idx = s.chunk_idx WHERE abs(ratio - mu) < 3 * sd GROUP BY 1, 2""",
)
def _(spark, sf):
    metric = _energy(spark, sf, spectral.energy_balance)
    return metric.select(*CHUNK, F.round("metric", 6).alias("metric"))


@query(
    "a17_robust_centre",
    f"""WITH {b.SIG}, stats AS (SELECT clip_id, avg(sample) AS mu, stddev_pop(sample) AS sd FROM sig GROUP BY 1)
    SELECT s.clip_id, round(median(sample), 6) AS centre FROM sig s JOIN stats t ON s.clip_id = t.clip_id
    WHERE abs(sample - mu) < 3 * sd GROUP BY 1""",
)
def _(spark, sf):
    centre = evaluate.robust_centre(b.signal(spark, sf), "clip_id", "sample")
    return centre.select("clip_id", F.round("centre", 6).alias("centre"))


def _resampled_sql(source: int, target: int) -> str:
    return f"""WITH {b.SIG}, n AS (SELECT clip_id, max(pos) + 1 AS n FROM sig GROUP BY 1),
    grid AS (SELECT clip_id, n, unnest(range(CAST(ceil(n * {target} / {source}) AS BIGINT))) AS grid FROM n),
    spots AS (SELECT *, grid * {source} / {target} AS spot FROM grid),
    ends AS (SELECT *, CAST(floor(spot) AS BIGINT) AS lo, least(CAST(floor(spot) AS BIGINT) + 1, n - 1) AS hi FROM spots)
    SELECT e.clip_id, e.grid, round(a.sample * (1 - (spot - lo)) + z.sample * (spot - lo), 6) AS sample
    FROM ends e JOIN sig a ON e.clip_id = a.clip_id AND e.lo = a.pos JOIN sig z ON e.clip_id = z.clip_id AND e.hi = z.pos"""


@query("x12_resample_up", _resampled_sql(5, 8))
def _(spark, sf):
    return spectral.resample_rows(b.signal(spark, sf), 5, 8).withColumn("sample", F.round("sample", 6))


@query("x12_resample_down", _resampled_sql(8, 5))
def _(spark, sf):
    return spectral.resample_rows(b.signal(spark, sf), 8, 5).withColumn("sample", F.round("sample", 6))


@query(
    "x12_resample_arrays",
    f"""WITH {b.WAVES}, grid AS (SELECT clip_id, samples, unnest(range(CAST(ceil(len(samples) * 8 / 5) AS BIGINT))) AS grid FROM waves),
    spots AS (SELECT *, grid * 5 / 8 AS spot, CAST(floor(grid * 5 / 8) AS BIGINT) AS lo FROM grid)
    SELECT clip_id, CAST(grid AS INTEGER) AS grid,
      round(samples[lo + 1] * (1 - (spot - lo)) + samples[least(lo + 2, len(samples))] * (spot - lo), 6) AS sample FROM spots""",
)
def _(spark, sf):
    out = b.waves(spark, sf).select("clip_id", F.posexplode(spectral.resample_array(F.col("samples"), 5, 8)).alias("grid", "sample"))
    return out.withColumn("sample", F.round("sample", 6))


@query(
    "x10_prediction_cepstrum_2",
    f"""WITH {WHOLE}, pairs AS (SELECT *, lag(v) OVER w AS p FROM ch WINDOW w AS (PARTITION BY clip_id, chunk_idx ORDER BY i)),
    first AS (SELECT clip_id, chunk_idx, -2 * sum(v * p) / sum(v * v + p * p) AS k FROM pairs WHERE i > 0 GROUP BY 1, 2),
    errors AS (SELECT r.clip_id, r.chunk_idx, i, v + k * p AS f, p + k * v AS b, k FROM pairs r
      JOIN first s ON r.clip_id = s.clip_id AND r.chunk_idx = s.chunk_idx WHERE i > 0),
    shifted AS (SELECT *, lag(b) OVER w AS q FROM errors WINDOW w AS (PARTITION BY clip_id, chunk_idx ORDER BY i)),
    second AS (SELECT clip_id, chunk_idx, any_value(k) AS k, -2 * sum(f * q) / sum(f * f + q * q) AS m FROM shifted
      WHERE i > 1 GROUP BY 1, 2)
    SELECT clip_id, chunk_idx, round(k + m * k, 6) AS c1, round(-(k + m * k) / 2, 6) AS c2 FROM second""",
)
def _(spark, sf):
    chunks = spectral.prediction_cepstrum(sequence.chunks(b.signal(spark, sf), 48), 2)
    at = lambda i: F.round(F.get("lpcc", F.lit(i)), 6)
    return chunks.select(*CHUNK, at(0).alias("c1"), at(1).alias("c2"))


@query("x10_prediction_cepstrum")
def _(spark, sf):
    chunks = spectral.prediction_cepstrum(sequence.chunks(b.signal(spark, sf), 48), 12)
    cells = chunks.select(*CHUNK, F.posexplode("lpcc").alias("i", "v"))
    return cells.withColumn("v", F.round("v", 6))


@query("x11_spectral_vector")
def _(spark, sf):
    chunks = sequence.chunks(b.signal(spark, sf), 48)
    named = chunks.select(F.format_string("%d-%d", "clip_id", "chunk_idx").alias("clip_id"), "samples")
    vectors = spectral.spectral_vector(named, nfft=128, hop=32, width=1)
    return vectors.select("clip_id", F.posexplode("features").alias("i", "v")).withColumn("v", F.round("v", 6))
