"""Long recordings in blocks: frames across borders, band-limited resampling."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.functions import transforms
from cliptide.operators import recordings, sequence, spectral

RNG = np.random.default_rng(4)


def rows_of(spark, waves):
    rows = [(clip, i, float(v)) for clip, wave in waves.items() for i, v in enumerate(wave)]
    return spark.createDataFrame(rows, "clip_id string, pos long, sample double").repartition(7)


def direct(wave, source, target, zeros):
    """The tapered sinc summed over all samples."""
    cut = min(1.0, target / source)
    half = zeros / cut
    grid = np.arange(-(-len(wave) * target // source))
    away = grid[:, None] * source / target - np.arange(len(wave))[None, :]
    taper = np.where(np.abs(away) < half, 0.42 + 0.5 * np.cos(np.pi * away / half) + 0.08 * np.cos(2 * np.pi * away / half), 0)
    return (cut * np.sinc(cut * away) * taper) @ np.asarray(wave, float)


def joined(blocks):
    out = {}
    for row in sorted(blocks.collect(), key=lambda r: (r.clip_id, r.block)):
        assert row.first == len(out.get(row.clip_id, []))
        out.setdefault(row.clip_id, []).extend(row.samples)
    return out


@pytest.mark.parametrize(("source", "target"), [(5, 8), (8, 5), (44_100, 16_000), (16_000, 16_000), (16_000, 44_100), (7, 1001)])
def test_blocks_same_as_direct_sum(spark, source, target):
    waves = {"a": RNG.normal(size=700), "b": RNG.normal(size=1), "c": RNG.normal(size=64), "d": RNG.normal(size=65)}
    got = joined(recordings.resample_blocks(rows_of(spark, waves), source, target, size=64, zeros=6))
    assert set(got) == set(waves)
    for clip, wave in waves.items():
        np.testing.assert_allclose(got[clip], direct(wave, source, target, 6), atol=1e-9)


def test_chunks_and_arrays_same_as_blocks(spark):
    waves = {"a": RNG.normal(size=500), "b": RNG.normal(size=30), "c": RNG.normal(size=100)}
    rows = [(k, i // 100, [float(x) for x in w[i : i + 100]]) for k, w in waves.items() for i in range(0, len(w), 100)]
    chunks = spark.createDataFrame(rows, "clip_id string, chunk_idx long, samples array<double>")
    got = joined(recordings.resample_chunks(chunks, 8, 5, 100, zeros=8))
    whole = spark.createDataFrame([(k, 8, [float(x) for x in w]) for k, w in waves.items()] + [("none", 8, None), ("rate", None, [1.0]), ("empty", 8, [])], "clip_id string, rate int, samples array<double>")
    arrays = dict(whole.select("clip_id", recordings.resample_sinc_array(F.col("samples"), F.col("rate"), 5, zeros=8)).collect())
    for clip, wave in waves.items():
        np.testing.assert_allclose(got[clip], direct(wave, 8, 5, 8), atol=1e-9)
        np.testing.assert_allclose(arrays[clip], direct(wave, 8, 5, 8), atol=1e-9)
    assert arrays["none"] is None and arrays["rate"] is None and arrays["empty"] == []
    with pytest.raises(ValueError):
        recordings.resample_chunks(chunks, 8, 5, 10, zeros=8)


def test_tones(spark):
    """From 16 kHz to 8 kHz a tone of 6 kHz goes (60 dB and more), one of 1 kHz stays as it is."""
    t = np.arange(16_000) / 16_000
    waves = {"high": np.sin(2 * np.pi * 6000 * t), "low": np.sin(2 * np.pi * 1000 * t)}
    got = joined(recordings.resample_blocks(rows_of(spark, waves), 16_000, 8_000, size=4096))
    inner = slice(200, -200)
    assert np.abs(np.array(got["high"])[inner]).max() < 1e-3
    want = np.sin(2 * np.pi * 1000 * np.arange(8000) / 8000)
    np.testing.assert_allclose(np.array(got["low"])[inner], want[inner], atol=1e-3)
    # Linear interpolation lets the high tone through, as one of 2 kHz.
    linear = spectral.resample_rows(rows_of(spark, {"high": waves["high"]}), 16_000, 8_000)
    assert linear.agg(F.max(F.abs("sample"))).first()[0] > 0.9


def test_one_long_clip_is_many_tasks(spark):
    long = spark.range(1_000_000).select(F.lit("a").alias("clip_id"), F.col("id").alias("pos"), F.sin(F.col("id") * 0.1).alias("sample"))
    made = recordings.resample_blocks(long, 44_100, 16_000, size=1 << 14)
    blocks = made.select("block", "first", F.size("samples").alias("n"), F.spark_partition_id().alias("task")).collect()
    assert len(blocks) == 62 and len({b.task for b in blocks}) >= 4
    assert sum(b.n for b in blocks) == -(-1_000_000 * 160 // 441)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


@pytest.mark.parametrize(("length", "hop"), [(16, 8), (16, 16), (8, 16), (15, 4)])
def test_frames_across_borders(spark, length, hop):
    waves = {"a": RNG.normal(size=203), "b": RNG.normal(size=length), "c": RNG.normal(size=length - 1)}
    frames = recordings.long_magnitudes(rows_of(spark, waves), 3 * hop, length, hop, 32).collect()
    got = {(r.clip_id, r.frame): r.magnitude for r in frames}
    assert len(got) == len(frames)
    want = {}
    for clip, wave in waves.items():
        for f in range((len(wave) - length) // hop + 1):
            want[clip, f] = np.abs(np.fft.rfft(wave[f * hop : f * hop + length] * transforms.hann(length), 32))
    assert set(got) == set(want)
    for key, value in want.items():
        np.testing.assert_allclose(got[key], value, atol=1e-9)


@pytest.mark.parametrize("hop", [96, 48])
def test_patches_across_blocks(spark, hop):
    wave = RNG.normal(size=96 * 160 * 5 + 300)
    got = {r.patch: r.frames for r in recordings.long_patches(rows_of(spark, {"a": wave}), 2, hop=hop).collect()}
    whole = spark.createDataFrame([("a", [float(x) for x in wave])], "clip_id string, samples array<double>")
    want = {r.patch: r.frames for r in spectral.log_mel_patches(whole, hop=hop).collect()}
    assert set(got) == set(want) and len(want) >= 4
    for patch, frames in want.items():
        np.testing.assert_allclose(np.array(got[patch], float), np.array(frames, float), atol=1e-5)


def test_refuses_and_empty(spark):
    with pytest.raises(ValueError):
        recordings.frame_reach(16, 5, 24)
    with pytest.raises(ValueError):
        recordings.Polyphase(0, 8)
    none = spark.createDataFrame([], "clip_id string, pos long, sample double")
    assert recordings.resample_sinc_rows(none, 5, 8).collect() == [] and recordings.long_magnitudes(none).collect() == []
    assert sequence.chunks(none, 5).collect() == []
