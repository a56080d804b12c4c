"""Arrow-batched numpy helpers for the transforms that Spark has no expression for."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def hann(length: int) -> np.ndarray:
    """Periodic Hann window."""
    return 0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length)


def next_power_of_two(length: int) -> int:
    return 1 << (length - 1).bit_length()


def dft_magnitude(length: int, nfft: int, windowed: bool = True):
    """Pandas UDF: frame of ``length`` samples → magnitudes of its ``nfft//2 + 1`` bins."""
    window = hann(length) if windowed else np.ones(length)

    @F.pandas_udf("array<double>")
    def magnitude(frames: pd.Series) -> pd.Series:
        if frames.empty:
            return pd.Series([], dtype=object)
        block = np.stack(frames.to_numpy()).astype(np.float64) * window
        return pd.Series(list(np.abs(np.fft.rfft(block, n=nfft, axis=1))))

    return magnitude


def _spectra(wave, length: int, hop: int, nfft: int, window: np.ndarray) -> np.ndarray:
    """[frames, bins] magnitudes of one waveform, complete frames only."""
    values = np.asarray(wave, np.float64)
    if len(values) < length:
        return np.empty((0, nfft // 2 + 1))
    block = np.lib.stride_tricks.sliding_window_view(values, length)[::hop]
    return np.abs(np.fft.rfft(block * window, n=nfft, axis=1))


def framed_magnitude(length: int, hop: int, nfft: int, windowed: bool = True, bins: slice = slice(None)):
    """Pandas UDF: waveform → [frames, bins] magnitudes; only ``bins`` leave Python."""
    window = hann(length) if windowed else np.ones(length)

    @F.pandas_udf("array<array<double>>")
    def magnitude(waves: pd.Series) -> pd.Series:
        return pd.Series([list(_spectra(w, length, hop, nfft, window)[:, bins]) for w in waves])

    return magnitude


def framed_log_mel(length: int, hop: int, nfft: int, weights: np.ndarray, offset: float):
    """Pandas UDF: waveform → [frames, bands] stabilised log of the mel projection."""
    window = hann(length)

    @F.pandas_udf("array<array<double>>")
    def log_mel(waves: pd.Series) -> pd.Series:
        return pd.Series([list(np.log(_spectra(w, length, hop, nfft, window) @ weights + offset)) for w in waves])

    return log_mel


def summed_power(nfft: int, hop: int):
    """Pandas UDF: waveform → Σ over frames of |X|²/nfft per bin; Hann frames of ``nfft``
    samples centred on multiples of ``hop``, with zeros beyond both ends."""
    window = hann(nfft)

    @F.pandas_udf("array<double>")
    def power(waves: pd.Series) -> pd.Series:
        out = []
        for wave in waves:
            padded = np.pad(np.asarray(wave, np.float64), nfft // 2)
            block = np.lib.stride_tricks.sliding_window_view(padded, nfft)[::hop]
            sums = np.zeros(nfft // 2 + 1)
            for start in range(0, len(block), 512):
                spectrum = np.fft.rfft(block[start : start + 512] * window, axis=1)
                sums += (np.abs(spectrum) ** 2 / nfft).sum(axis=0)
            out.append(sums)
        return pd.Series(out)

    return power


def burg_coefficients(signal: np.ndarray, order: int) -> np.ndarray:
    """Linear-prediction polynomial by Burg's recursion on forward and backward errors."""
    forward, backward = signal[1:].copy(), signal[:-1].copy()
    poly = np.array([1.0])
    for _ in range(order):
        energy = forward @ forward + backward @ backward
        reflection = -2.0 * (backward @ forward) / energy if energy > 0 else 0.0
        extended = np.append(poly, 0.0)
        poly = extended + reflection * extended[::-1]
        forward, backward = (
            (forward + reflection * backward)[1:],
            (backward + reflection * forward)[:-1],
        )
    return poly


def cepstrum(poly: np.ndarray) -> np.ndarray:
    """Cepstral values 1..order of a prediction polynomial, as the feature defines them."""
    order = len(poly) - 1
    values = np.zeros(order + 1)
    values[1] = poly[1]
    for n in range(2, order + 1):
        weights = np.arange(1, n) / n
        values[n] = weights * values[1:n] @ poly[n - 2 :: -1] - poly[n - 1]
    return values[1:]


def lpc_cepstrum(order: int = 12):
    """Pandas UDF: waveform → ``order`` linear-prediction cepstral values."""

    @F.pandas_udf("array<double>")
    def lpcc(waves: pd.Series) -> pd.Series:
        return pd.Series([cepstrum(burg_coefficients(np.asarray(w, np.float64), order)) for w in waves])

    return lpcc


def fit_weights(points: int, degree: int, keep: int) -> np.ndarray:
    """[keep, points] matrix that maps values at x = 0..points-1 to their polynomial fit."""
    x = np.linspace(-1.0, 1.0, points)
    basis, _ = np.linalg.qr(np.polynomial.legendre.legvander(x, degree))
    return basis[:keep] @ basis.T


def mel_weights(bands: int, bins: int, rate: float, low: float, high: float) -> np.ndarray:
    """[bins, bands] triangular weights, evenly spaced on the mel scale; the DC bin has none."""
    mel = lambda hz: 1127.0 * np.log1p(hz / 700.0)
    edges = np.linspace(mel(low), mel(high), bands + 2)
    centre = mel(np.linspace(0.0, rate / 2, bins))[:, None]
    rising = (centre - edges[:-2]) / (edges[1:-1] - edges[:-2])
    falling = (edges[2:] - centre) / (edges[2:] - edges[1:-1])
    weights = np.maximum(0.0, np.minimum(rising, falling))
    weights[0] = 0.0
    return weights


def predictor(apply, loader, result: str):
    """Pandas UDF: ``apply(loader(), batch)``, where the batch is a list of arrays.

    ``loader`` runs once per Python worker. Rows may differ in length, which the built-in
    batch predictor does not allow.
    """
    state = {}

    @F.pandas_udf(result)
    def predict(batch: pd.Series) -> pd.Series:
        if "model" not in state:
            state["model"] = loader()
        return pd.Series(list(apply(state["model"], list(batch))))

    return predict
