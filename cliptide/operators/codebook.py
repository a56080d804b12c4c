"""Sequences pooled against a learned codebook: what each frame adds to its nearest code word.

Mean and maximum say little about a sequence whose frames have several modes. Here frames are grouped around
code words, and a sequence is described by the sums of its frames' differences from them, word by word.
``parts`` cuts a sequence into that many stretches, each with sums of its own, which keeps the order of
stretches.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.operators.exact import hash_key, names


def nearest(rows: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Index of the nearest word of each row; ties to the smaller one."""
    # Differences, not the expanded square: equal words must stay equally far.
    best, far = np.zeros(len(rows), np.int64), np.full(len(rows), np.inf)
    for i, word in enumerate(words):
        distance = ((rows - word) ** 2).sum(axis=1)
        closer = distance < far
        best[closer], far[closer] = i, distance[closer]
    return best


@dataclass
class Codebook:
    words: np.ndarray

    @property
    def width(self) -> int:
        return self.words.shape[1]

    def residuals(self, frames: np.ndarray, parts: int = 1) -> np.ndarray:
        """Sums of differences of the frames from their words, divided by the frames' number: parts x words x width."""
        sums = np.zeros((parts, len(self.words), self.width))
        if len(frames):
            word = nearest(frames, self.words)
            np.add.at(sums, (np.arange(len(frames)) * parts // len(frames), word), frames - self.words[word])
            sums /= len(frames)
        return sums

    def column(self, frames: Column, parts: int = 1) -> Column:
        """``residuals`` of an array of frames, flat; null for null. Null frames are left out."""

        @F.pandas_udf("array<double>")
        def pooled(batch: pd.Series) -> pd.Series:
            def one(sequence):
                if sequence is None:
                    return None
                held = [f for f in sequence if f is not None]
                return self.residuals(np.array([np.asarray(f, np.float64) for f in held]).reshape(len(held), self.width), parts).ravel()

            return batch.map(one)

        return pooled(frames)


def _partial_sums(values: str, words: np.ndarray):
    """For ``mapInPandas``: (word, n, sums) of the rows of a task, so that few rows are shuffled."""

    def run(batches):
        count, sums = np.zeros(len(words), np.int64), np.zeros(words.shape)
        for batch in batches:
            if len(batch):
                rows = np.stack([np.asarray(v, np.float64) for v in batch[values]])
                word = nearest(rows, words)
                count += np.bincount(word, minlength=len(words))
                np.add.at(sums, word, rows)
        held = np.flatnonzero(count)
        # A task without rows says nothing: an empty column of lists has no type that Arrow could convert.
        if len(held):
            yield pd.DataFrame({"word": held, "n": count[held], "sums": list(sums[held])})

    return run


def learn_codebook(df: DataFrame, values: str, key: str | Sequence[str], words: int = 16, rounds: int = 10, seed: int = 42) -> Codebook:
    """Seeded k-means over rows of ``values``: the rows first in the hash order of ``key`` begin as words, and each
    round moves a word to the mean of the rows nearest to it. A word without rows stays.

    Rows with null values take no part. A round is one pass in which every task sends one sum a word; only words
    reach the driver. Fewer rows than ``words`` give as many words as there are rows; none is an error.
    """
    rows = df.filter(F.col(values).isNotNull())
    first = rows.orderBy(hash_key(seed, *names(key)), *names(key)).limit(words).select(F.col(values).cast("array<double>")).collect()
    if not first:
        raise ValueError("no row to learn code words from")
    centres = np.array([r[0] for r in first])
    rows = rows.select(F.col(values).cast("array<double>").alias("v")).persist()
    try:
        for _ in range(rounds):
            parts = rows.mapInPandas(_partial_sums("v", centres), "word int, n long, sums array<double>")
            # Sums of one task each: a row for every (word, place), added up by Spark.
            added = parts.select("word", "n", F.posexplode("sums").alias("place", "s")).groupBy("word", "place").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))
            moved = centres.copy()
            for r in added.collect():
                moved[r.word, r.place] = r.s / r.n
            if np.array_equal(moved, centres):
                break
            centres = moved
    finally:
        rows.unpersist()
    return Codebook(centres)


def residual_pooled(df: DataFrame, book: Codebook, frames: str = "frames", name: str = "features", parts: int = 1) -> DataFrame:
    """``df`` with the pooled residuals as a vector of parts x words x width values; rows without frames go."""
    # A separate column: the condition must not run the pooling again.
    pooled = df.filter(F.size(frames) > 0).withColumn(name, book.column(F.col(frames), parts))
    return pooled.withColumn(name, array_to_vector(name))


def residual_preparation(
    key: str | Sequence[str], frames: str = "frames", words: int = 16, rounds: int = 10, parts: int = 1, seed: int = 42
):
    """For ``learn.fold_predictions``: a codebook from the frames of a fold's training rows only."""

    def fit(train: DataFrame):
        each = train.select(*names(key), F.posexplode(frames).alias("_frame", "_values"))
        book = learn_codebook(each, "_values", [*names(key), "_frame"], words, rounds, seed)
        return lambda df: residual_pooled(df, book, frames, parts=parts)

    return fit
