"""Signal and spectral features.

Clips arrive as one waveform array per row, or as long (clip_id, pos, sample) rows. The array
form never shuffles; the long form shares even a single huge clip between tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cliptide.functions import arrays, transforms
from cliptide.operators.exact import names, running, settled
from cliptide.operators.sequence import chunk_arrays, in_order
from cliptide.operators.tiles import tiled_map, weight_cells

# Fixed values of the front end.
SAMPLE_RATE = 16_000
WINDOW, HOP = 400, 160
MEL_BANDS, MEL_LOW, MEL_HIGH = 64, 125.0, 7500.0
LOG_OFFSET = 0.01
PATCH_FRAMES = 96


# --- linear maps -------------------------------------------------------------------------


MAX_CELLS = 500_000


def weight_table(spark: SparkSession, **columns: np.ndarray) -> DataFrame:
    """(in_idx, out_idx, weight columns) of constant [in, out] matrices, without all-zero cells.

    The table is broadcast, so matrices beyond ``MAX_CELLS`` are refused: ``tiled_map`` takes them.
    """
    matrices = list(columns.values())
    if matrices[0].size > MAX_CELLS:
        raise ValueError(f"a matrix of {matrices[0].size} cells is too large to broadcast")
    rows, cols = np.nonzero(np.any([m != 0 for m in matrices], axis=0))
    cells = [(int(i), int(o), *[float(m[i, o]) for m in matrices]) for i, o in zip(rows, cols)]
    fields = ", ".join(f"{name} double" for name in columns)
    return F.broadcast(spark.createDataFrame(cells, f"in_idx int, out_idx int, {fields}"))


def _mapped(df: DataFrame, weights: DataFrame, by: Sequence[str], idx: str, value: str) -> DataFrame:
    rows = df.select(*by, F.col(idx).cast("int").alias("in_idx"), F.col(value).alias("_v"))
    return rows.join(weights, "in_idx").groupBy(*by, "out_idx")


def linear_map(df: DataFrame, matrix: np.ndarray, by: Sequence[str], idx: str, value: str, name: str = "value") -> DataFrame:
    """Σ value·weight per (by…, out_idx) for a constant [in, out] matrix: a broadcast join on
    the input index whose sums are combined map-side; beyond ``MAX_CELLS`` a product of tiles."""
    if matrix.size > MAX_CELLS:
        return tiled_map(df, weight_cells(df.sparkSession, matrix), by, idx, value, name)
    grouped = _mapped(df, weight_table(df.sparkSession, w=matrix), by, idx, value)
    return grouped.agg(F.sum(F.col("_v") * F.col("w")).alias(name))


def dft_rows(df: DataFrame, length: int, nfft: int, by: Sequence[str], idx: str, value: str, windowed: bool = True) -> DataFrame:
    """Framed transform as a join with the cosine and sine tables; (by…, bin, magnitude)."""
    phase = 2 * np.pi / nfft * np.outer(np.arange(length), np.arange(nfft // 2 + 1))
    taper = (transforms.hann(length) if windowed else np.ones(length))[:, None]
    real, imaginary, bins = taper * np.cos(phase), taper * np.sin(phase), nfft // 2 + 1
    if real.size > MAX_CELLS:
        both = linear_map(df, np.hstack([real, imaginary]), by, idx, value, "_s")
        part = lambda at: F.coalesce(F.sum(F.when(at, F.col("_s"))), F.lit(0.0))
        sums = both.groupBy(*by, (F.col("out_idx") % bins).alias("out_idx")).agg(
            part(F.col("out_idx") < bins).alias("_re"), part(F.col("out_idx") >= bins).alias("_im")
        )
    else:
        sums = _mapped(df, weight_table(df.sparkSession, re=real, im=imaginary), by, idx, value).agg(
            F.sum(F.col("_v") * F.col("re")).alias("_re"), F.sum(F.col("_v") * F.col("im")).alias("_im")
        )
    magnitude = F.sqrt(F.col("_re") * F.col("_re") + F.col("_im") * F.col("_im"))
    return sums.select(*by, F.col("out_idx").alias("bin"), magnitude.alias("magnitude"))


# --- front end over waveform arrays ------------------------------------------------------


def magnitudes(df: DataFrame, length: int = WINDOW, hop: int = HOP, nfft: int | None = None, samples: str = "samples") -> DataFrame:
    """One row per frame with its ``magnitude`` array."""
    nfft = nfft or transforms.next_power_of_two(length)
    framed = transforms.framed_magnitude(length, hop, nfft)
    others = [c for c in df.columns if c != samples]
    return df.select(*others, F.posexplode(framed(samples)).alias("frame", "magnitude"))


def mel_bands(df: DataFrame, by: Sequence[str], bins: int, bands: int = MEL_BANDS, rate: float = SAMPLE_RATE, low: float = MEL_LOW, high: float = MEL_HIGH) -> DataFrame:
    """Mel projection of long (by…, bin, magnitude) rows."""
    weights = transforms.mel_weights(bands, bins, rate, low, high)
    return linear_map(df, weights, by, "bin", "magnitude", "mel").withColumnRenamed("out_idx", "band")


def mel_arrays(magnitude: Column, bins: int, bands: int = MEL_BANDS, rate: float = SAMPLE_RATE, low: float = MEL_LOW, high: float = MEL_HIGH) -> Column:
    """Mel projection of one magnitude array: no join and no shuffle. Each band is a short
    weighted slice, as its triangle covers consecutive bins."""
    matrix = transforms.mel_weights(bands, bins, rate, low, high)
    cells = []
    for band in range(bands):
        used = np.flatnonzero(matrix[:, band])
        if len(used) == 0:
            cells.append(F.lit(0.0))
            continue
        weights = F.array(*[F.lit(float(w)) for w in matrix[used[0] : used[-1] + 1, band]])
        part = F.slice(magnitude, int(used[0]) + 1, int(used[-1] - used[0]) + 1)
        cells.append(arrays.total(F.zip_with(part, weights, lambda a, b: a * b)))
    return F.array(*cells)


def stabilised_log(value: Column, offset: float = LOG_OFFSET) -> Column:
    return F.log(value + F.lit(offset))


def patches(df: DataFrame, clip: Sequence[str], frame: str = "frame", value: str = "mel", size: int = PATCH_FRAMES, hop: int = PATCH_FRAMES) -> DataFrame:
    """Groups of ``size`` consecutive frames, complete ones only, as [frames] of ``value``."""
    first = F.greatest(F.ceil((F.col(frame) - size + 1) / hop), F.lit(0))
    last = F.floor(F.col(frame) / hop)
    pairs = F.array_sort(F.collect_list(F.struct(F.col(frame).alias("f"), F.col(value).alias("v"))))
    return (
        df.filter(first <= last)
        .select(*clip, frame, value, F.explode(F.sequence(first, last)).alias("patch"))
        .groupBy(*clip, "patch")
        .agg(F.transform(pairs, lambda x: x["v"]).alias("frames"))
        .filter(F.size("frames") == size)
    )


def log_mel_patches(df: DataFrame, samples: str = "samples", size: int = PATCH_FRAMES, hop: int = PATCH_FRAMES) -> DataFrame:
    """Waveforms → log-mel patches, with the fixed front-end parameters: one pass, no shuffle,
    and only the bands leave Python."""
    nfft = transforms.next_power_of_two(WINDOW)
    weights = transforms.mel_weights(MEL_BANDS, nfft // 2 + 1, SAMPLE_RATE, MEL_LOW, MEL_HIGH)
    mel = transforms.framed_log_mel(WINDOW, HOP, nfft, weights, LOG_OFFSET)(samples)
    others = [c for c in df.columns if c != samples]
    return df.select(*others, mel.alias("_mel")).select(
        *others, F.posexplode(arrays.frames(F.col("_mel"), size, hop)).alias("patch", "frames")
    )


# --- power spectrum family ---------------------------------------------------------------


def power_spectrum(df: DataFrame, nfft: int = 2048, hop: int = 128, samples: str = "samples", name: str = "power") -> DataFrame:
    return df.withColumn(name, transforms.summed_power(nfft, hop)(samples))


def segment_shares(df: DataFrame, clip: str | Sequence[str], bin: str, power: str, width: int, bins: int, name: str = "share") -> DataFrame:
    """Sums over bins of ``width``, incomplete last one dropped, as shares of their total.

    ``bins`` is the spectrum size; the share of a silent clip is NULL.
    """
    by = names(clip)
    sums = (
        df.filter(F.col(bin) < bins // width * width)
        .groupBy(*by, F.floor(F.col(bin) / width).alias("seg"))
        .agg(F.sum(power).alias("_s"))
    )
    whole = sums.groupBy(*by).agg(F.sum("_s").alias("_t"))
    return sums.join(whole, by).select(*by, "seg", F.try_divide("_s", "_t").alias(name))


def linearity(df: DataFrame, clip: str | Sequence[str], seg: str = "seg", share: str = "share") -> DataFrame:
    """``rho``: correlation of the cumulative share with its index. ``q``: leading coefficient
    of the quadratic fit of an even 0..8 grid on the cumulative share."""
    by = names(clip)
    cdf = running(df, by, seg, share, "sum", "_x").withColumn("_x2", F.col("_x") * F.col("_x"))
    index = F.col(seg).cast("double")
    sums = cdf.groupBy(*by).agg(
        F.covar_pop("_x", index).alias("xy"),
        F.covar_pop("_x2", index).alias("x2y"),
        F.covar_pop("_x", F.col("_x2")).alias("xx2"),
        F.var_pop("_x").alias("vx"),
        F.var_pop("_x2").alias("vx2"),
        F.var_pop(index).alias("vy"),
        F.max(index).alias("top"),
    )
    c = F.col
    rho = F.try_divide(c("xy"), F.sqrt(c("vx") * c("vy")))
    slope = F.try_divide(c("x2y") * c("vx") - c("xy") * c("xx2"), c("vx2") * c("vx") - c("xx2") * c("xx2"))
    return sums.select(*by, rho.alias("rho"), (slope * F.try_divide(F.lit(8.0), c("top"))).alias("q"))


def local_maxima(df: DataFrame, clip: str | Sequence[str], pos: str = "pos", value: str = "value", height: float = 0.0, block: int = 4096) -> DataFrame:
    """Peaks of at least ``height``: strictly above both neighbours; a flat top counts once, at
    its middle (rounded down); the first and last points are never peaks.

    Positions are consecutive. Neighbours come from a one-sample halo around each block, runs
    of equal values from a blocked running maximum, so one long clip is many tasks.
    """
    by = names(clip)
    within = _neighbours(df.select(*by, F.col(pos).cast("bigint").alias("_p"), F.col(value).alias("_v")), by, block)
    marked = within.withColumn(
        "_start", F.when(F.col("_prev").isNull() | (F.col("_prev") != F.col("_v")), F.col("_p"))
    )
    runs = running(marked, by, "_p", "_start", "max", "_run", block)
    tops = (
        runs.groupBy(*by, F.col("_run").alias("_from"))
        .agg(
            F.max("_p").alias("_to"),
            F.max("_v").alias(value),
            F.max(F.when(F.col("_p") == F.col("_run"), F.col("_prev"))).alias("_before"),
            F.max(F.when(F.col("_next") != F.col("_v"), F.col("_next"))).alias("_after"),
        )
        .filter((F.col("_before") < F.col(value)) & (F.col("_after") < F.col(value)) & (F.col(value) >= height))
    )
    return tops.select(*by, F.floor((F.col("_from") + F.col("_to")) / 2).alias(pos), value)


def _neighbours(df: DataFrame, by: Sequence[str], block: int) -> DataFrame:
    """Previous and next value of each position: every sample is sent to the blocks of its
    neighbours too, then each block looks only at itself."""
    own = F.floor(F.col("_p") / block)
    homes = F.array_distinct(
        F.array(own, F.floor((F.col("_p") + 1) / block), F.floor(F.greatest(F.col("_p") - 1, F.lit(0)) / block))
    )
    spread = df.withColumn("_own", own).withColumn("_block", F.explode(homes))
    window = Window.partitionBy(*by, "_block").orderBy("_p")
    return (
        spread.withColumn("_prev", F.lag("_v").over(window))
        .withColumn("_next", F.lead("_v").over(window))
        .filter("_block = _own")
        .drop("_own", "_block")
    )


def strong_peaks(peaks: DataFrame, clip: str | Sequence[str], value: str = "value", omega: float = 0.3) -> DataFrame:
    """Peaks of at least ``omega`` times the clip's highest peak."""
    by = names(clip)
    highest = peaks.groupBy(*by).agg(F.max(value).alias("_top"))
    return peaks.join(highest, by).filter(F.col(value) >= F.col("_top") * F.lit(omega)).drop("_top")


def peak_features(df: DataFrame, clip: str | Sequence[str], pos: str = "pos", value: str = "value", omega: float = 0.3) -> DataFrame:
    """Count, mean and population deviation of the positions of strong peaks. A clip without
    peaks has count 0 and NULL for the others."""
    by = names(clip)
    strong = strong_peaks(local_maxima(df, by, pos, value), by, value, omega)
    stats = strong.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n_peak"), F.avg(pos).alias("mu_peak"), F.stddev_pop(pos).alias("sigma_peak")
    )
    clips = df.groupBy(*by).agg(F.lit(1).alias("_any")).drop("_any")
    return clips.join(stats, by, "left").withColumn("n_peak", F.coalesce("n_peak", F.lit(0)))


def smooth_fit(df: DataFrame, clip: str | Sequence[str], points: int, pos: str = "pos", value: str = "value", degree: int = 6, keep: int = 32) -> DataFrame:
    """First ``keep`` values of the polynomial fit through each clip's ``points`` values."""
    weights = transforms.fit_weights(points, degree, keep).T
    return linear_map(df, weights, names(clip), pos, value, "fit").withColumnRenamed("out_idx", pos)


def low_power(df: DataFrame, keep: int = 48, seg: str = "seg", share: str = "share") -> DataFrame:
    """First segments, as percentages."""
    return df.filter(F.col(seg) < keep).withColumn(share, F.col(share) * 100)


# --- energy balance ----------------------------------------------------------------------


def energy_balance_frames(
    df: DataFrame, rate: int = SAMPLE_RATE, nfft: int = 4096, frame: int | None = None, low: int = 20, high: int = 250,
    cutoff: int = 80, strict_cutoff: bool = False, samples: str = "samples",
) -> DataFrame:
    """Per frame: share of the low bins in the magnitude of all kept bins.

    Kept bins run from ``low`` to ``high`` Hz. As defined, ``cutoff`` counts bins from the
    first kept one; ``strict_cutoff`` makes it a frequency. A silent frame is NULL.
    """
    others = [c for c in df.columns if c != samples]
    ratios = _energy_ratios(samples, rate, nfft, frame, low, high, cutoff, strict_cutoff)
    return df.select(*others, ratios.alias("_r")).select(*others, F.posexplode("_r").alias("frame", "ratio"))


def _energy_ratios(samples, rate, nfft, frame, low, high, cutoff, strict_cutoff) -> Column:
    length = frame or int(0.1 * rate)
    first, last, cut = (int(hz * nfft / rate) for hz in (low, high, cutoff))
    used = cut - first if strict_cutoff else cut
    kept = transforms.framed_magnitude(length, length, nfft, False, slice(first, last + 1))(samples)
    return F.transform(kept, lambda m: F.try_divide(arrays.total(F.slice(m, 1, used)), arrays.total(m)))


def energy_balance(
    df: DataFrame, rate: int = SAMPLE_RATE, nfft: int = 4096, frame: int | None = None, low: int = 20, high: int = 250,
    cutoff: int = 80, strict_cutoff: bool = False, samples: str = "samples",
) -> DataFrame:
    """Energy balance of each chunk: outlying frames dropped, then the median. A chunk with a
    silent frame, or with all frames alike, has no value and says why. No shuffle."""
    others = [c for c in df.columns if c != samples]
    ratios = _energy_ratios(samples, rate, nfft, frame, low, high, cutoff, strict_cutoff)
    silent = F.exists("_r", lambda r: r.isNull())
    note = F.when(F.col("_silent"), "silent frame").when(F.col("metric").isNull(), "constant series")
    return (
        df.select(*others, ratios.alias("_r"))
        .withColumn("_silent", silent)
        .withColumn("metric", F.when(~F.col("_silent"), arrays.robust_centre_of(F.col("_r"))))
        .select(*others, "metric", note.alias("error"))
    )


# --- prediction cepstrum, assembly, resampling -------------------------------------------


def prediction_cepstrum(df: DataFrame, order: int = 12, samples: str = "samples", name: str = "lpcc") -> DataFrame:
    return df.withColumn(name, transforms.lpc_cepstrum(order)(samples))


def spectral_vector(df: DataFrame, clip: str = "clip_id", samples: str = "samples", nfft: int = 2048, hop: int = 128, width: int = 14, low: int = 48, omega: float = 0.3, degree: int = 6, fitted: int = 32, order: int = 12) -> DataFrame:
    """The 97-value vector per clip: linearity 2, peaks 35, cepstrum 12, low power 48.

    One waveform per row in, one vector out. Both transforms share a single pass over the
    waveforms; its few dozen numbers per clip are written once, and only those are grouped
    and joined.
    """
    thin = settled(
        df.select(
            clip,
            transforms.summed_power(nfft, hop)(samples).alias("_power"),
            transforms.lpc_cepstrum(order)(samples).alias("_lpcc"),
        ).select(clip, arrays.shares(arrays.bin_sums(F.col("_power"), width)).alias("_share"), "_lpcc"),
        "spectra",
    )
    segments = thin.select(clip, F.posexplode("_share").alias("seg", "share"))
    percent = low_power(segments, low)
    head = linearity(segments, clip).join(peak_features(percent, clip, "seg", "share", omega), clip)
    fit = smooth_fit(percent, clip, low, "seg", "share", degree, fitted)
    fits = fit.groupBy(clip).agg(in_order("seg", "fit").alias("_fit"))
    values = F.array(*[F.col(c).cast("double") for c in ("rho", "q", "n_peak", "mu_peak", "sigma_peak")])
    lows = F.transform(F.slice("_share", 1, low), lambda s: s * 100)
    return thin.join(head, clip).join(fits, clip).select(
        clip, F.concat(values, "_fit", "_lpcc", lows).alias("features")
    )


def resample_rows(df: DataFrame, source: int, target: int, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """Linear interpolation onto a uniform grid of another rate; the last value is held.

    Each sample adds to the grid points within one source step, so it is one aggregation and
    no self-join; a long clip spreads over its grid points.
    """
    p = F.col(pos).cast("bigint")
    first = F.floor((p - 1) * F.lit(target) / F.lit(source)) + 1
    first = F.greatest(first, F.lit(0))
    last = F.ceil((p + 1) * F.lit(target) / F.lit(source)) - 1
    near = df.withColumn("_first", first).withColumn("_last", last).filter("_first <= _last")
    spread = near.select(clip, p.alias("_p"), F.col(value).alias("_v"), F.explode(F.sequence("_first", "_last")).alias("grid"))
    weight = 1 - F.abs(F.col("grid") * F.lit(source) / F.lit(target) - F.col("_p"))
    sums = spread.withColumn("_w", weight).groupBy(clip, "grid").agg(
        F.sum(F.col("_w") * F.col("_v")).alias("_s"), F.sum("_w").alias("_t")
    )
    return sums.filter("_t > 0").select(clip, "grid", (F.col("_s") / F.col("_t")).alias(value))


def resample_array(samples: Column, source: int | Column, target: int) -> Column:
    """The same for one waveform array; ``source`` may be a column of rates."""
    source = F.lit(source) if isinstance(source, int) else source
    n = F.size(samples)
    size = F.ceil(n * F.lit(target) / source).cast("int")

    def at(j: Column) -> Column:
        spot = j * source / F.lit(target)
        low = F.floor(spot).cast("int")
        high = F.least(low + 1, n - 1)
        part = spot - low
        return F.get(samples, low) * (1 - part) + F.get(samples, high) * part

    return F.when(n > 0, F.transform(F.sequence(F.lit(0), size - 1), at)).otherwise(F.array().cast("array<double>"))


def chunk_energy(df: DataFrame, seconds: float = 5.0, rate: int = SAMPLE_RATE, samples: str = "samples") -> DataFrame:
    """Waveforms → full chunks of ``seconds`` → energy balance per chunk."""
    return energy_balance(chunk_arrays(df, int(seconds * rate), samples), rate=rate, samples=samples)
