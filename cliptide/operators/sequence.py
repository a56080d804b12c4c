"""Chunks, frames and sequence shaping over long (clip, pos, value) rows or array columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.functions import arrays
from cliptide.operators.exact import names, row_index


def in_order(pos: str, value: str):
    """Values of a bounded group as an array, ordered by position."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(value).alias("v"))))
    return F.transform(pairs, lambda x: x["v"])


def chunks(df: DataFrame, pace: int, clip: str = "clip_id", pos: str = "pos", value: str = "sample") -> DataFrame:
    """Full chunks of ``pace`` samples per clip; the tail is dropped. Groups hold ``pace`` rows."""
    return (
        df.groupBy(clip, F.floor(F.col(pos) / pace).alias("chunk_idx"))
        .agg(in_order(pos, value).alias("samples"))
        .filter(F.size("samples") == pace)
    )


def chunk_arrays(df: DataFrame, pace: int, samples: str = "samples") -> DataFrame:
    """The same for one waveform array per row: no shuffle."""
    cut = arrays.frames(F.col(samples), pace, pace)
    others = [c for c in df.columns if c != samples]
    return df.select(*others, F.posexplode(cut).alias("chunk_idx", samples))


def frame_rows(
    df: DataFrame, length: int, hop: int, clip: str = "clip_id", pos: str = "pos", value: str = "sample", block: int = 4096
) -> DataFrame:
    """Sliding frames of long rows with consecutive positions; complete frames only.

    Samples are gathered in blocks of about ``block``, each with the few samples that its last
    frames reach into, so hardly any sample is shuffled twice however much the frames overlap.
    """
    per_block = -(-max(block, length) // hop)
    size = per_block * hop
    own = F.floor(F.col(pos) / size)
    reaches_back = (F.col(pos) % size < length - hop) & (own > 0)
    homes = F.when(reaches_back, F.array(own - 1, own)).otherwise(F.array(own))
    blocks = (
        df.select(clip, pos, value, F.explode(homes).alias("_block"))
        .groupBy(clip, "_block")
        .agg(in_order(pos, value).alias("samples"))
    )
    cut = blocks.select(clip, "_block", F.posexplode(arrays.frames(F.col("samples"), length, hop)).alias("_i", "samples"))
    return cut.select(clip, (F.col("_block") * per_block + F.col("_i")).alias("frame"), "samples")


def frame_arrays(df: DataFrame, length: int, hop: int, samples: str = "samples") -> DataFrame:
    cut = arrays.frames(F.col(samples), length, hop)
    others = [c for c in df.columns if c != samples]
    return df.select(*others, F.posexplode(cut).alias("frame", samples))


def sequences(
    df: DataFrame, key: str, pos: str = "pos", frame: str = "embedding", keep: Sequence[str] = (), length: int | None = None
) -> DataFrame:
    """One row per sequence with its frames in order; ``keep`` columns come from the first frame.

    Give ``length`` when only that many leading frames are used (0-based ``pos``): the others
    are left out before the shuffle, so the longest clip costs no more than any other.
    """
    if length is not None:
        df = df.filter(F.col(pos) < length)
    firsts = [F.min_by(c, pos).alias(c) for c in keep]
    return df.groupBy(key).agg(in_order(pos, frame).alias("frames"), *firsts)


def pad_sequences(df: DataFrame, width: int, length: int = 31, frames: str = "frames") -> DataFrame:
    """Cut or zero-pad at the end to ``length`` frames of ``width`` values."""
    return df.withColumn(frames, arrays.fit_length(F.col(frames), length, arrays.zero_frame(width)))


def pad_to_longest(df: DataFrame, width: int, frames: str = "frames") -> DataFrame:
    longest = df.agg(F.max(F.size(frames))).scalar()
    return df.withColumn(frames, arrays.fit_length(F.col(frames), longest, arrays.zero_frame(width)))


def rechunk(
    df: DataFrame, order: str | Sequence[str], width: int, size: int = 62, frame: str = "embedding", label: str = "label"
) -> DataFrame:
    """Re-cut one flat frame stream into sequences of ``size``: the tail is zero-padded, the
    label is that of the first row. An exact multiple gets no extra empty sequence."""
    placed = row_index(df.select(*dict.fromkeys([*names(order), frame, label])), order, "_idx")
    placed = placed.withColumn("seq_id", F.floor(F.col("_idx") / size)).withColumn("_pos", F.col("_idx") % size)
    whole = sequences(placed, "seq_id", "_pos", frame, [label])
    return pad_sequences(whole, width, size)


def pool_pairs(df: DataFrame, frames: str = "frames") -> DataFrame:
    return df.withColumn(frames, arrays.pool_pairs(F.col(frames)))


def label_frames(df: DataFrame, frames: str = "frames", name: str = "embedding") -> DataFrame:
    """One row per frame, each with its clip's label."""
    others = [c for c in df.columns if c != frames]
    return df.select(*others, F.posexplode(frames).alias("frame", name))
