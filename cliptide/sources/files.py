"""Audio and feature files: listing, decoding, metadata, and the bad-record split.

Decoders take (path, content) rows, from any binary scan, or bare (path) rows whose files the
decoding task opens itself: join the thin listing with labels first, and no audio is shuffled.
A file that cannot be decoded becomes a row with an ``error``; nothing is dropped silently.
"""

from __future__ import annotations

import io
import struct
import wave
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyarrow.fs import FileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def binary_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    """(path, length, content). Spark packs files into tasks by their size in bytes, and does
    not read ``content`` when only the other columns are used."""
    return (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", pattern)
        .option("recursiveFileLookup", True)
        .load(folder)
        .select("path", "length", "content")
    )


def list_files(spark: SparkSession, folder: str, pattern: str = "*.wav") -> DataFrame:
    return binary_files(spark, folder, pattern).select("path", "length")


def spread_by_bytes(listed: DataFrame, target: int = 256 << 20) -> DataFrame:
    """Deal listed files to tasks of about ``target`` bytes each. The listing itself is thin, so
    neither its own size nor adaptive coalescing would give a sensible number of tasks."""
    total = listed.agg(F.sum("length")).first()[0] or 0
    return listed.repartition(max(1, -(-total // target)), "path")


def _records(batch: pd.DataFrame) -> Iterator[tuple[str, bytes | None]]:
    contents = batch["content"] if "content" in batch else [None] * len(batch)
    return zip(batch["path"], contents)


def _opened(path: str, content: bytes | None):
    """The given bytes, or else the file at ``path``, as a seekable file. The task itself opens
    it, on whatever file system the address names, and reads no more than it uses."""
    if content is not None:
        return io.BytesIO(content)
    local = path.startswith("file:/") and not path.startswith("file://")
    system, inner = FileSystem.from_uri("file://" + path[5:] if local else path)
    return system.open_input_file(inner)


class _FloatClip:
    """A WAV file of 32-bit floats (format 3), which ``wave`` does not open: what the decoders use of it."""

    def __init__(self, file):
        head, form = file.read(12), None
        if head[:4] != b"RIFF" or head[8:] != b"WAVE":
            raise ValueError("no RIFF file")
        while len(top := file.read(8)) == 8:
            name, size = struct.unpack("<4sI", top)
            if name == b"data" and form:
                break
            body = file.read(size + size % 2)  # chunks begin at even places
            if name == b"fmt ":
                form = struct.unpack_from("<HHIIHH", body)
        else:
            raise ValueError("no samples")
        kind, self.channels, self.rate, _, _, bits = form
        if (kind, bits) != (3, 32):
            raise ValueError(f"expected 32-bit floats, found {bits} bits of format {kind}")
        self.file, self.frames = file, size // (4 * self.channels)

    getframerate = lambda self: self.rate
    getnchannels = lambda self: self.channels
    getnframes = lambda self: self.frames
    getsampwidth = lambda self: 4

    def readframes(self, count: int) -> bytes:
        return self.file.read(count * 4 * self.channels)


@contextmanager
def _open_pcm(path: str, content: bytes | None):
    """A clip of 16-bit samples, or of 32-bit floats."""
    with _opened(path, content) as file:
        try:
            clip = wave.open(file)
            if clip.getsampwidth() != 2:
                raise ValueError(f"expected 16-bit samples, found {8 * clip.getsampwidth()}-bit")
        except wave.Error as error:
            if str(error) != "unknown format: 3":
                raise
            file.seek(0)
            clip = _FloatClip(file)
        yield clip


def _bytes_or_path(files: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    used = ["path", "content"] if "content" in files.columns else ["path"]
    return files.select(*used, *keep)


def wav_metadata(files: DataFrame) -> DataFrame:
    """(path, sr, channels, n_samples, error) from the header alone."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for path, content in _records(batch):
                try:
                    with _open_pcm(path, content) as clip:
                        rows.append((path, clip.getframerate(), clip.getnchannels(), clip.getnframes(), None))
                except Exception as error:
                    rows.append((path, None, None, None, f"{type(error).__name__}: {error}"))
            yield pd.DataFrame(rows, columns=["path", "sr", "channels", "n_samples", "error"]).astype(
                {"sr": "Int32", "channels": "Int32", "n_samples": "Int64"}
            )

    schema = "path string, sr int, channels int, n_samples bigint, error string"
    return _bytes_or_path(files).mapInPandas(read, schema)


def duration(metadata: DataFrame) -> DataFrame:
    return metadata.withColumn("duration", F.try_divide(F.col("n_samples"), F.col("sr")))


def decode_wav(files: DataFrame, chunk: int | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """(path, sr, channels, chunk_idx, samples, error, keep…): mono float samples, 16-bit ones in [-1, 1).

    16-bit PCM is scaled by 1/32768, 32-bit floats stay as they are; channels are averaged. With ``chunk`` the clip is
    cut into full chunks of that many samples, each its own row; otherwise it is one row. Join
    the labels before this step and ``keep`` their columns: then unlabelled clips are not
    decoded, and no join has to move samples.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = ["path", "sr", "channels", "chunk_idx", "samples", "error"]
        types = {"sr": "Int32", "channels": "Int32", "chunk_idx": "Int32"}
        for batch in batches:
            for place, (path, content) in enumerate(_records(batch)):
                try:
                    with _open_pcm(path, content) as clip:
                        rate, channels, frames = clip.getframerate(), clip.getnchannels(), clip.getnframes()
                        kind, scale = ("<i2", 32768.0) if clip.getsampwidth() == 2 else ("<f4", 1.0)
                        pcm = np.frombuffer(clip.readframes(frames), dtype=kind)
                    if len(pcm) != frames * channels:
                        raise ValueError(f"truncated: {len(pcm)} of {frames * channels} samples")
                    samples = (pcm.reshape(-1, channels) / scale).mean(axis=1, dtype=np.float64).astype(np.float32)
                    cut = chunk or max(len(samples), 1)
                    count = len(samples) // cut if chunk else 1
                    rows = [(path, rate, channels, i, samples[i * cut : (i + 1) * cut], None) for i in range(count)]
                except Exception as error:
                    rows = [(path, None, None, None, None, f"{type(error).__name__}: {error}")]
                if rows:
                    kept = {name: batch[name].iloc[place] for name in keep}
                    yield pd.DataFrame(rows, columns=columns).astype(types).assign(**kept)

    schema = T.StructType.fromDDL(
        "path string, sr int, channels int, chunk_idx int, samples array<float>, error string"
    )
    for name in keep:
        schema = schema.add(files.schema[name])
    return _bytes_or_path(files, keep).mapInPandas(read, schema)


def _float_wav(data: bytes, rate: int) -> bytes:
    form = struct.pack("<4sIHHIIHHH", b"fmt ", 18, 3, 1, rate, 4 * rate, 4, 32, 0)
    body = b"WAVE" + form + struct.pack("<4sII", b"fact", 4, len(data) // 4) + struct.pack("<4sI", b"data", len(data)) + data
    return struct.pack("<4sI", b"RIFF", len(body)) + body


def encode_wav(df: DataFrame, rate: int, samples: str = "samples", name: str = "content") -> DataFrame:
    """Mono WAV bytes of an integer sample array: 16-bit, or 32-bit floats of the same scale (1 for 32768) for a clip
    with samples beyond 16 bits. Floats are exact to 24 bits."""

    @F.pandas_udf("binary")
    def encode(waves: pd.Series) -> pd.Series:
        out = []
        for values in waves:
            whole = np.asarray(values)
            if ((whole < -32768) | (whole > 32767)).any():
                out.append(_float_wav((whole / 32768.0).astype("<f4").tobytes(), rate))
                continue
            buffer = io.BytesIO()
            with wave.open(buffer, "wb") as clip:
                clip.setnchannels(1)
                clip.setsampwidth(2)
                clip.setframerate(rate)
                clip.writeframes(np.asarray(values, dtype="<i2").tobytes())
            out.append(buffer.getvalue())
        return pd.Series(out)

    return df.withColumn(name, encode(samples))


def decode_npy(files: DataFrame) -> DataFrame:
    """(path, frame, embedding, error): one row per frame of a 2-D array (a 1-D array is one
    frame). Pickled objects are refused."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in _records(batch):
                try:
                    with _opened(path, content) as file:
                        loaded = np.load(io.BytesIO(file.read()), allow_pickle=False)
                    values = np.atleast_2d(loaded).astype(np.float32)
                    if values.ndim != 2:
                        raise ValueError(f"expected 2 dimensions, found {values.ndim}")
                    rows = [(path, i, row, None) for i, row in enumerate(values)]
                except Exception as error:
                    rows = [(path, None, None, f"{type(error).__name__}: {error}")]
                if rows:
                    yield pd.DataFrame(rows, columns=["path", "frame", "embedding", "error"]).astype({"frame": "Int32"})

    return _bytes_or_path(files).mapInPandas(
        read, "path string, frame int, embedding array<float>, error string"
    )


def encode_npy(df: DataFrame, values: str, name: str = "content") -> DataFrame:
    @F.pandas_udf("binary")
    def encode(arrays: pd.Series) -> pd.Series:
        out = []
        for array in arrays:
            buffer = io.BytesIO()
            np.save(buffer, np.asarray(list(array), dtype=np.float32), allow_pickle=False)
            out.append(buffer.getvalue())
        return pd.Series(out)

    return df.withColumn(name, encode(values))


def good_records(df: DataFrame) -> DataFrame:
    return df.filter(F.col("error").isNull()).drop("error")


def bad_records(df: DataFrame, path: str = "path") -> DataFrame:
    return df.filter(F.col("error").isNotNull()).select(path, "error")
