"""Column expressions over arrays: padding, pooling, framing, encodings. All stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def argmax(scores: Column) -> Column:
    """0-based index of the largest value; the first one wins a tie."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def one_hot(label: Column, classes: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def pcm_to_unit(samples: Column) -> Column:
    return F.transform(samples, lambda x: x / F.lit(32768.0))


def downmix(*channels: Column) -> Column:
    """Mean over channels, sample by sample."""
    total = channels[0]
    for other in channels[1:]:
        total = F.zip_with(total, other, lambda a, b: a.cast("double") + b.cast("double"))
    return F.transform(total, lambda x: x / F.lit(float(len(channels))))


def features_of(row: Column) -> Column:
    """All but the last element of a labelled row."""
    return F.slice(row, F.lit(1), F.size(row) - 1)


def label_of(row: Column) -> Column:
    return F.element_at(row, -1)


def fit_length(values: Column, length: int | Column, fill: Column | None = None) -> Column:
    """Cut to ``length`` elements or append ``fill`` (0.0) at the end."""
    fill = F.lit(0.0) if fill is None else fill
    length = F.lit(length) if isinstance(length, int) else length
    return F.when(F.size(values) >= length, F.slice(values, F.lit(1), length)).otherwise(
        F.concat(values, F.array_repeat(fill, (length - F.size(values)).cast("int")))
    )


def zero_frame(width: int) -> Column:
    return F.array_repeat(F.lit(0.0).cast("float"), width)


def padded_size(size: Column, first: int, hop: int) -> Column:
    """Samples needed for a whole number of patches: one of ``first``, then steps of ``hop``."""
    extra = F.greatest(size - F.lit(first), F.lit(0))
    return (F.lit(first) + F.ceil(extra / hop) * hop).cast("int")


def pad_to_patches(samples: Column, first: int, hop: int) -> Column:
    return fit_length(samples, padded_size(F.size(samples), first, hop))


def pool_pairs(frames: Column) -> Column:
    """Elementwise mean of frames (0,1), (2,3), …; an odd last frame is dropped."""
    pairs = F.floor(F.size(frames) / 2).cast("int")
    mean = lambda i: F.zip_with(
        F.get(frames, i * 2), F.get(frames, i * 2 + 1), lambda a, b: (a.cast("double") + b.cast("double")) / 2
    )
    steps = F.when(pairs > 0, F.sequence(F.lit(0), pairs - 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, mean)


def frames(samples: Column, length: int, hop: int) -> Column:
    """Complete frames of ``length`` samples, every ``hop`` samples."""
    last = F.floor((F.size(samples) - length) / hop).cast("int")
    starts = F.when(F.size(samples) >= length, F.sequence(F.lit(0), last)).otherwise(
        F.array().cast("array<int>")
    )
    return F.transform(starts, lambda i: F.slice(samples, i * hop + 1, F.lit(length)))


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x.cast("double"))


def scaled(values: Column, factor: Column) -> Column:
    return F.transform(values, lambda x: x * factor)


def bin_sums(values: Column, width: int) -> Column:
    """Sums over consecutive bins of ``width`` values; an incomplete last bin is dropped."""
    return F.transform(frames(values, width, width), total)


def shares(values: Column) -> Column:
    whole = total(values)
    return F.transform(values, lambda x: F.try_divide(x, whole))


def median_of(values: Column) -> Column:
    """Median of a short array; NULL when it is empty."""
    ordered = F.array_sort(values)
    n = F.size(values)
    low, high = F.floor((n - 1) / 2).cast("int"), F.floor(n / 2).cast("int")
    return (F.get(ordered, low) + F.get(ordered, high)) / 2


def robust_centre_of(values: Column, limit: float = 3.0) -> Column:
    """Median of the values within ``limit`` population deviations; NULL for a constant array."""
    n = F.size(values)
    mean = F.try_divide(total(values), n)
    square = F.aggregate(values, F.lit(0.0), lambda acc, x: acc + (x - mean) * (x - mean))
    sigma = F.sqrt(F.try_divide(square, n))
    return median_of(F.filter(values, lambda x: F.abs(x - mean) < sigma * limit))
