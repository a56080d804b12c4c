"""Long recordings as blocks of samples, so that hours of one clip are many rows and many tasks.

A block holds ``size`` consecutive samples and a halo of its neighbours' samples, as many as a frame or a
filter reaches beyond the block. What is computed from one block then never needs another one. Every sample
is shuffled once, those of the halo once more for each neighbour.
"""

from __future__ import annotations

from math import gcd

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators import spectral

#: Zero crossings of the interpolating filter on each side.
ZEROS = 32


def sample_blocks(df: DataFrame, size: int, before: int = 0, after: int = 0, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """(clip, block, first, samples) of long rows (clip, pos, value) with consecutive positions from 0.

    ``samples`` are those of positions ``block * size - before`` to ``(block + 1) * size + after - 1``, as
    far as the clip has them; ``first`` is the position of the first one.
    """
    if size < 1 or before < 0 or after < 0:
        raise ValueError("a block needs at least one sample, and a halo cannot be negative")
    p = F.col(pos).cast("bigint")
    low = F.greatest(F.floor((p - after) / size), F.lit(0))
    homes = F.sequence(low, F.floor((p + before) / size))
    spread = df.select(clip, p.alias("_p"), F.col(value).cast("double").alias("_v"), F.explode(homes).alias("block"))
    own = F.floor(F.col("_p") / size) == F.col("block")
    cells = F.array_sort(F.collect_list(F.struct("_p", "_v")))
    grouped = spread.groupBy(clip, "block").agg(cells.alias("_c"), F.max(own).alias("_own"))
    # A block beyond the end of the clip would hold nothing but halo.
    return grouped.filter("_own").select(clip, "block", F.col("_c")[0]["_p"].alias("first"), F.transform("_c", lambda c: c["_v"]).alias("samples"))


def chunk_blocks(df: DataFrame, size: int, before: int = 0, after: int = 0, clip: str = "clip_id", chunk: str = "chunk_idx", samples: str = "samples") -> DataFrame:
    """The same from rows (clip, chunk, samples) whose chunks hold ``size`` samples, the last one maybe fewer.

    A chunk sends its neighbours only what they need of it: halos may be at most ``size``.
    """
    if max(before, after) > size:
        raise ValueError("a halo longer than a chunk needs samples of further chunks")
    part = lambda to, place, cells: F.struct(to.alias("block"), F.lit(place).alias("place"), cells.alias("cells"))
    at, own = F.col(chunk).cast("bigint"), F.transform(samples, lambda x: x.cast("double"))
    parts = [part(at, 1, own)]
    if after:
        parts.append(part(at - 1, 2, F.slice(own, 1, after)))
    if before:
        parts.append(part(at + 1, 0, F.slice(own, F.greatest(F.size(own) - before + 1, F.lit(1)), F.lit(before))))
    sent = df.select(clip, F.explode(F.array(*parts)).alias("_p")).select(clip, "_p.*")
    cells = F.array_sort(F.collect_list(F.struct("place", "cells")))
    grouped = sent.groupBy(clip, "block").agg(cells.alias("_c"), F.max(F.col("place") == 1).alias("_own")).filter("_own")
    halo = F.when(F.col("_c")[0]["place"] == 0, F.size(F.col("_c")[0]["cells"])).otherwise(0)
    return grouped.select(clip, "block", (F.col("block") * size - halo).alias("first"), F.flatten(F.transform("_c", lambda c: c["cells"])).alias("samples"))


# --- frames ------------------------------------------------------------------------------


def frame_reach(length: int, hop: int, size: int) -> int:
    """Samples that the frames beginning in a block of ``size`` need beyond it."""
    if size % hop:
        raise ValueError(f"blocks of {size} samples are not a whole number of hops of {hop}")
    return max(0, length - hop)


def block_magnitudes(blocks: DataFrame, size: int, length: int = spectral.WINDOW, hop: int = spectral.HOP, nfft: int | None = None, clip: str = "clip_id") -> DataFrame:
    """(clip, frame, magnitude) of blocks with a halo of ``frame_reach`` behind them: each frame belongs to the
    block in which it begins, and no frame is lost or seen twice at a border."""
    frame_reach(length, hop, size)
    spectra = spectral.magnitudes(blocks.select(clip, "block", "samples"), length, hop, nfft)
    per_block = size // hop
    return spectra.filter(F.col("frame") < per_block).select(clip, (F.col("block") * per_block + F.col("frame")).alias("frame"), "magnitude")


def long_magnitudes(df: DataFrame, size: int = 1 << 16, length: int = spectral.WINDOW, hop: int = spectral.HOP, nfft: int | None = None, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """Framed transform of long rows, in blocks of about ``size`` samples: (clip, frame, magnitude)."""
    size = max(1, size // hop) * hop
    blocks = sample_blocks(df, size, 0, frame_reach(length, hop, size), clip, pos, value)
    return block_magnitudes(blocks, size, length, hop, nfft, clip)


def long_patches(df: DataFrame, patches: int = 8, frames: int = spectral.PATCH_FRAMES, hop: int = spectral.PATCH_FRAMES, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """Log-mel patches (clip, patch, frames) of long rows: blocks of ``patches`` patch hops, so that no second
    shuffle puts frames together."""
    size = patches * hop * spectral.HOP
    reach = max(0, (frames - hop) * spectral.HOP + spectral.WINDOW - spectral.HOP)
    made = spectral.log_mel_patches(sample_blocks(df, size, 0, reach, clip, pos, value).select(clip, "block", "samples"), "samples", frames, hop)
    return made.filter(F.col("patch") < patches).select(clip, (F.col("block") * patches + F.col("patch")).alias("patch"), "frames")


# --- band-limited resampling -------------------------------------------------------------


class Polyphase:
    """Resampling by ``up / down`` (in lowest terms) with a windowed sinc: one row of coefficients per phase.

    The output at grid point m lies at source position m * down / up, whose fraction takes only ``up``
    values. The filter cuts at the lower of the two Nyquist rates, reaches ``zeros`` of its zero crossings
    to each side and is tapered by a Blackman window; samples beyond the clip count as 0.
    """

    #: Rows of coefficients kept at once.
    HELD = 4096

    def __init__(self, source: int, target: int, zeros: int = ZEROS):
        if source < 1 or target < 1:
            raise ValueError("sample rates must be positive")
        common = gcd(source, target)
        self.up, self.down, self.zeros = target // common, source // common, zeros
        self.cut = min(1.0, self.up / self.down)
        self.half = zeros / self.cut
        self.reach = int(np.ceil(self.half))
        self.rows: dict[int, np.ndarray] = {}

    def row(self, phase: int) -> np.ndarray:
        """Weights of the ``2 * reach`` samples around a grid point: from ``reach - 1`` before its floor to
        ``reach`` after it."""
        found = self.rows.get(phase)
        if found is None:
            away = phase / self.up - np.arange(1 - self.reach, self.reach + 1)
            turn = np.pi * away / self.half
            taper = np.where(np.abs(away) < self.half, 0.42 + 0.5 * np.cos(turn) + 0.08 * np.cos(2 * turn), 0.0)
            found = self.cut * np.sinc(self.cut * away) * taper
            if len(self.rows) < self.HELD:
                self.rows[phase] = found
        return found

    def grid(self, first: int, last: int) -> tuple[int, int]:
        """The grid points at source positions from ``first`` up to (not including) ``last``."""
        return -(-first * self.up // self.down), -(-last * self.up // self.down)

    def values(self, samples: np.ndarray, start: int, first: int, last: int) -> np.ndarray:
        """Grid points from ``first`` up to ``last``, from samples of which the first has position ``start``."""
        around = 2 * self.reach
        padded = np.concatenate([np.zeros(around), samples, np.zeros(around)])
        views = np.lib.stride_tricks.sliding_window_view(padded, around)
        points = np.arange(first, last)
        begins = points * self.down // self.up - (self.reach - 1) - start + around
        phases = points * self.down % self.up
        out = np.zeros(len(points))
        inside = (begins >= 0) & (begins < len(views))
        if len(points) >= 4 * self.up:
            # Points of one phase are one strided product.
            for phase in range(min(self.up, len(points))):
                some = slice(phase, None, self.up)
                ok = inside[some]
                out[some][ok] = views[begins[some][ok]] @ self.row(int(phases[phase]))
        else:
            for at in range(0, len(points), 1024):
                some = np.flatnonzero(inside[at : at + 1024]) + at
                if len(some):
                    weights = np.stack([self.row(int(q)) for q in phases[some]])
                    out[some] = np.einsum("ij,ij->i", views[begins[some]], weights)
        return out


def resample_blocks(df: DataFrame, source: int, target: int, size: int = 1 << 16, zeros: int = ZEROS, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """(clip, block, first, samples) at another rate, of long rows: band-limited, one shuffle of the samples.

    ``first`` is the grid point of the first sample. A clip of n samples gets ceil(n * target / source).
    """
    filter_ = Polyphase(source, target, zeros)
    blocks = sample_blocks(df, size, filter_.reach - 1, filter_.reach, clip, pos, value)
    return _resampled(blocks, size, filter_, clip)


def resample_chunks(df: DataFrame, source: int, target: int, size: int, zeros: int = ZEROS, clip: str = "clip_id", chunk: str = "chunk_idx", samples: str = "samples") -> DataFrame:
    """The same for rows of chunks of ``size`` samples."""
    filter_ = Polyphase(source, target, zeros)
    return _resampled(chunk_blocks(df, size, filter_.reach - 1, filter_.reach, clip, chunk, samples), size, filter_, clip)


def _resampled(blocks: DataFrame, size: int, filter_: Polyphase, clip: str) -> DataFrame:
    @F.pandas_udf("struct<first: bigint, samples: array<double>>")
    def convert(block: pd.Series, first: pd.Series, samples: pd.Series) -> pd.DataFrame:
        rows = []
        for b, at, wave in zip(block, first, samples):
            end = min((b + 1) * size, at + len(wave))
            low, high = filter_.grid(int(b) * size, int(end))
            rows.append((low, filter_.values(np.asarray(wave, np.float64), int(at), low, high)))
        return pd.DataFrame(rows, columns=["first", "samples"])

    return blocks.select(clip, "block", convert("block", "first", "samples").alias("_r")).select(clip, "block", "_r.*")


def resample_sinc_rows(df: DataFrame, source: int, target: int, size: int = 1 << 16, zeros: int = ZEROS, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """Long rows (clip, grid, value) at another rate."""
    made = resample_blocks(df, source, target, size, zeros, clip, pos, value)
    return made.select(clip, "first", F.posexplode("samples").alias("_i", value)).select(clip, (F.col("first") + F.col("_i")).alias("grid"), value)


def resample_sinc_array(samples: Column, source: int | Column, target: int, zeros: int = ZEROS) -> Column:
    """One waveform array at another rate; ``source`` may be a column of rates. No shuffle. A null rate or
    waveform gives null."""
    source = F.lit(source) if isinstance(source, int) else source

    @F.pandas_udf("array<double>")
    def convert(waves: pd.Series, rates: pd.Series) -> pd.Series:
        filters: dict[int, Polyphase] = {}
        out = []
        for wave, rate in zip(waves, rates):
            if wave is None or pd.isna(rate):
                out.append(None)
                continue
            filter_ = filters.setdefault(int(rate), Polyphase(int(rate), target, zeros))
            low, high = filter_.grid(0, len(wave))
            out.append(filter_.values(np.asarray(wave, np.float64), 0, low, high))
        return pd.Series(out, dtype=object)

    return convert(samples, source)
