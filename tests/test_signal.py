"""Signal features against numpy on small waveforms."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.functions import arrays, transforms
from cliptide.operators import evaluate, sequence, spectral

RATE = 16_000


def waveforms(spark):
    """Three seconds each of silence, noise and a 440 Hz sine."""
    rng = np.random.default_rng(51773)
    time = np.arange(3 * RATE) / RATE
    rows = [
        ("silence", [0.0] * (3 * RATE)),
        ("noise", rng.uniform(-1, 1, 3 * RATE).tolist()),
        ("sine", np.sin(2 * np.pi * 440 * time).tolist()),
    ]
    return spark.createDataFrame(rows, "clip_id string, samples array<double>").repartition(3)


def test_sine_has_one_loud_bin(spark):
    frames = spectral.magnitudes(waveforms(spark))
    assert frames.filter("clip_id = 'sine'").count() == 1 + (3 * RATE - 400) // 160
    top = frames.select("clip_id", arrays.argmax(F.col("magnitude")).alias("bin"), F.array_max("magnitude").alias("peak"))
    seen = {r.clip_id: (r.lo, r.hi, r.peak) for r in top.groupBy("clip_id").agg(
        F.min("bin").alias("lo"), F.max("bin").alias("hi"), F.max("peak").alias("peak")).collect()}
    assert seen["sine"][:2] == (14, 14)
    assert seen["silence"][2] == 0.0


def test_log_mel_patches(spark):
    clips = sequence.chunk_arrays(waveforms(spark), 3 * RATE)
    patches = spectral.log_mel_patches(clips).select("clip_id", "patch", "frames").collect()
    assert sorted((r.clip_id, r.patch) for r in patches) == [(c, p) for c in ("noise", "silence", "sine") for p in range(3)]
    silence = np.array(next(r.frames for r in patches if r.clip_id == "silence"))
    assert silence.shape == (96, 64) and np.allclose(silence, math.log(0.01))
    noise = next(r for r in patches if r.clip_id == "noise" and r.patch == 1)
    wave = np.random.default_rng(51773).uniform(-1, 1, 3 * RATE)
    frame = wave[96 * 160 : 96 * 160 + 400] * (0.5 - 0.5 * np.cos(2 * np.pi * np.arange(400) / 400))
    mel = np.abs(np.fft.rfft(frame, 512)) @ transforms.mel_weights(64, 257, RATE, 125.0, 7500.0)
    assert np.allclose(noise.frames[0], np.log(mel + 0.01))


def test_short_clip_has_no_frames(spark):
    df = spark.createDataFrame([("a", [0.1] * 399), ("b", [0.1] * 400)], "clip_id string, samples array<double>")
    assert [r.clip_id for r in spectral.magnitudes(df).collect()] == ["b"]
    assert [r.clip_id for r in sequence.frame_arrays(df, 400, 160).collect()] == ["b"]


@pytest.mark.parametrize("n, chunks", [(0, 0), (15, 0), (16, 1), (17, 1), (32, 2)])
def test_chunks_drop_the_tail(spark, n, chunks):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(n)], "clip_id int, pos int, sample double")
    assert sequence.chunks(rows, 16).count() == chunks


def test_hop_longer_than_frame(spark):
    rows = spark.createDataFrame([(1, i, float(i)) for i in range(12)], "clip_id int, pos int, sample double")
    got = {r.frame: r.samples for r in sequence.frame_rows(rows, 2, 5).collect()}
    assert got == {0: [0.0, 1.0], 1: [5.0, 6.0], 2: [10.0, 11.0]}


@pytest.mark.parametrize("length, hop", [(5, 2), (4, 4), (3, 7), (9, 1), (20, 3)])
def test_frames_across_blocks(spark, length, hop):
    clips = {"a": 103, "b": length, "c": length - 1, "d": 1}
    rows = spark.createDataFrame([(c, i, float(i)) for c, n in clips.items() for i in range(n)], "clip_id string, pos int, sample double")
    got = {(r.clip_id, r.frame): r.samples for r in sequence.frame_rows(rows.repartition(3), length, hop, block=10).collect()}
    want = {
        (c, f): [float(i) for i in range(f * hop, f * hop + length)]
        for c, n in clips.items() for f in range(n) if f * hop + length <= n
    }
    assert got == want


@pytest.mark.parametrize("n", [0, 1, 31, 32, 62, 63])
def test_sequence_shapes(spark, n):
    df = spark.createDataFrame([(1, [[float(i)] * 2 for i in range(n)])], "id int, frames array<array<float>>")
    padded = sequence.pad_sequences(df, 2, 31).first().frames
    assert len(padded) == 31
    assert [f[0] for f in padded] == [float(i) if i < n else 0.0 for i in range(31)]
    pooled = sequence.pool_pairs(df).first().frames
    assert [f[0] for f in pooled] == [2 * i + 0.5 for i in range(n // 2)]


def test_rechunk_exact_multiple(spark):
    rows = [(i, i // 62, [float(i), 1.0]) for i in range(124)]
    df = spark.createDataFrame(rows, "n int, label int, embedding array<float>")
    whole = sequence.rechunk(df, "n", 2).orderBy("seq_id").collect()
    assert [(r.seq_id, r.label, len(r.frames)) for r in whole] == [(0, 0, 62), (1, 1, 62)]
    part = sequence.rechunk(df.filter("n < 63"), "n", 2).orderBy("seq_id").collect()
    assert part[1].frames[0] == [62.0, 1.0] and part[1].frames[1:] == [[0.0, 0.0]] * 61


def peaks_by_hand(values):
    found, i = [], 1
    while i < len(values) - 1:
        if values[i - 1] < values[i]:
            end = i
            while end < len(values) - 1 and values[end + 1] == values[i]:
                end += 1
            if end < len(values) - 1 and values[end + 1] < values[i]:
                found.append((i + end) // 2)
            i = end
        i += 1
    return found


@pytest.mark.parametrize("block", [4, 1000])
def test_local_maxima(spark, block):
    rng = np.random.default_rng(3)
    clips = {"steps": rng.integers(0, 4, 400).tolist(), "flat": [2] * 40, "up": list(range(40)), "long top": [0] + [5] * 30 + [1]}
    rows = [(c, i, float(v)) for c, vs in clips.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, "clip string, pos int, value double").repartition(4)
    got = {}
    for r in spectral.local_maxima(df, "clip", block=block).collect():
        got.setdefault(r.clip, []).append(r.pos)
    assert {c: sorted(p) for c, p in got.items()} == {c: peaks_by_hand(v) for c, v in clips.items() if peaks_by_hand(v)}
    features = {r.clip: r for r in spectral.peak_features(df, "clip").collect()}
    assert (features["flat"].n_peak, features["flat"].mu_peak) == (0, None)
    assert features["long top"].mu_peak == 15


def test_spectral_vector(spark):
    rng = np.random.default_rng(8)
    waves = {f"c{i}": rng.normal(0, 1, 3000) * np.hanning(3000) for i in range(2)}
    df = spark.createDataFrame([(c, w.tolist()) for c, w in waves.items()], "clip_id string, samples array<double>")
    got = {r.clip_id: np.array(r.features, float) for r in spectral.spectral_vector(df).collect()}
    for clip, wave in waves.items():
        padded = np.pad(wave, 1024)
        window = 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(2048) / 2048)
        frames = [np.fft.rfft(padded[s : s + 2048] * window) for s in range(0, len(padded) - 2047, 128)]
        power = sum(np.abs(f) ** 2 / 2048 for f in frames)
        share = power[: 73 * 14].reshape(73, 14).sum(axis=1)
        share /= share.sum()
        cdf, low = np.cumsum(share), share[:48] * 100
        rho = np.corrcoef(cdf, np.arange(73))[0, 1]
        q = np.polyfit(cdf, np.linspace(0, 8, 73), 2)[0]
        peaks = np.array(peaks_by_hand(low.tolist()))
        peaks = peaks[low[peaks] >= 0.3 * low[peaks].max()]
        fit = np.polyval(np.polyfit(np.arange(48), low, 6), np.arange(48))[:32]
        vector = got[clip]
        assert len(vector) == 97
        assert np.allclose(vector[:2], [rho, q], rtol=1e-4)
        assert np.allclose(vector[2:5], [len(peaks), peaks.mean(), peaks.std()])
        assert np.allclose(vector[5:37], fit, atol=1e-6)
        assert np.allclose(vector[49:], low)


def test_prediction_polynomial():
    """Burg's recursion recovers the coefficients of a long autoregressive signal."""
    rng = np.random.default_rng(1)
    x = np.zeros(20_000)
    for i in range(2, len(x)):
        x[i] = 1.3 * x[i - 1] - 0.6 * x[i - 2] + rng.normal()
    poly = transforms.burg_coefficients(x, 2)
    assert np.allclose(poly, [1.0, -1.3, 0.6], atol=0.02)
    assert np.allclose(transforms.burg_coefficients(np.zeros(50), 3), [1, 0, 0, 0])
    poly = np.array([1.0, 0.5, -0.25, 0.125])
    second = -0.5 + 0.5 * poly[0] * 0.5
    third = 0.25 + 1 / 3 * poly[1] * 0.5 + 2 / 3 * poly[0] * second
    assert np.allclose(transforms.cepstrum(poly), [0.5, second, third])


def test_energy_balance(spark):
    time = np.arange(5 * RATE) / RATE
    noise = np.random.default_rng(2).normal(0, 1, 5 * RATE)
    rows = [
        ("low", np.sin(2 * np.pi * 60 * time) + 0.001 * noise),
        ("high", np.sin(2 * np.pi * 200 * time) + 0.001 * noise),
        ("noise", noise),
        ("silent", np.where(time < 0.3, 0.0, noise)),
        ("short", noise[: 4 * RATE]),
    ]
    df = spark.createDataFrame([(c, w.tolist()) for c, w in rows], "clip_id string, samples array<double>")
    got = {r.clip_id: r for r in spectral.chunk_energy(df).collect()}
    assert set(got) == {"low", "high", "noise", "silent"}
    assert got["silent"].metric is None and got["silent"].error == "silent frame"
    assert 0 <= got["high"].metric < 0.5 < got["low"].metric <= 1
    frames = noise.reshape(50, 1600)
    kept = np.abs(np.fft.rfft(frames, 4096))[:, 5:65]
    ratio = kept[:, :20].sum(axis=1) / kept.sum(axis=1)
    ratio = ratio[np.abs(ratio - ratio.mean()) < 3 * ratio.std()]
    assert np.isclose(got["noise"].metric, np.median(ratio))


def test_robust_centre(spark):
    rows = [("outlier", 1.0), ("outlier", 100.0)] + [("outlier", 2.0 + i / 100) for i in range(20)] + [("constant", 4.0)] * 5
    df = spark.createDataFrame(rows, "g string, v double")
    got = {r.g: r for r in evaluate.robust_centre(df, "g", "v").collect()}
    values = np.array([v for g, v in rows if g == "outlier"])
    kept = values[np.abs(values - values.mean()) < 3 * values.std()]
    assert got["outlier"].centre == np.median(kept) and len(kept) == 21
    assert got["constant"].centre is None and got["constant"].error == "constant series"


def test_histogram_matches_numpy(spark):
    rng = np.random.default_rng(0)
    groups = {"a": rng.normal(0, 1, 500).round(2), "b": np.full(4, 3.0), "c": np.arange(11) / 10}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {}
    for r in evaluate.histogram(df, "g", "v", 10).collect():
        got.setdefault(r.g, {})[r.bin] = r.n
    for g, vs in groups.items():
        counts, _ = np.histogram(vs, 10)
        assert got[g] == {i: n for i, n in enumerate(counts) if n}


def test_resampled_array_equals_rows(spark):
    rng = np.random.default_rng(6)
    waves = {i: rng.normal(0, 1, n).tolist() for i, n in enumerate((1, 2, 7, 50))}
    df = spark.createDataFrame(list(waves.items()), "clip_id int, samples array<double>")
    rows = df.select("clip_id", F.posexplode("samples").alias("pos", "sample"))
    for source, target in ((3, 7), (7, 3), (2, 1), (1, 2)):
        narrow = df.select("clip_id", spectral.resample_array(F.col("samples"), source, target).alias("s")).collect()
        long = {(r.clip_id, r.grid): r.sample for r in spectral.resample_rows(rows, source, target).collect()}
        for r in narrow:
            spots = np.arange(math.ceil(len(waves[r.clip_id]) * target / source)) * source / target
            want = np.interp(spots, np.arange(len(waves[r.clip_id])), waves[r.clip_id])
            assert np.allclose(r.s, want)
            assert np.allclose([long[r.clip_id, i] for i in range(len(want))], want)
        assert len(long) == sum(len(r.s) for r in narrow)
