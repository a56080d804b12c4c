"""Language identification as a mixture of languages.

Each language is a distribution over hashed byte trigrams of letters. A document's trigrams are
taken as drawn from a mixture of languages; expectation-maximisation estimates its proportions, and
the number of languages is the one whose likelihood, less a penalty for every language after the
first, is largest.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import Sent, append_struct, free_name, held_out, plain_bytes, slices

BUCKETS = 1 << 16
#: Bytes of text in a slice, and of one array of probabilities: what stays in a core's cache.
SLICE, ROUND = 1 << 20, 1 << 21
UNKNOWN = "und"
_WORD_MARK = re.compile(r"[^\W\d_]")
_LETTERS_ONLY = bytes(c if 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed trigrams of all texts, and where each text's begin (one bound more than texts).

    Whatever is no letter counts as a space; trigrams with two neighbouring spaces are left out,
    which also separates the texts.
    """
    plain = [t.decode("utf-8", "replace").lower().encode("utf-8").translate(_LETTERS_ONLY) if t else b"" for t in texts]
    joined = np.frombuffer(b"  " + b"  ".join(plain) + b"  ", np.uint8)
    space = joined == 0x20
    codes = joined.astype(np.uint32)
    codes = (codes[:-2] << 16) | (codes[1:-1] << 8) | codes[2:]
    used = ~((space[:-2] & space[1:-1]) | (space[1:-1] & space[2:]))
    hashed = ((codes * np.uint32(2654435761)) >> np.uint32(16))[used]
    before = np.concatenate([[0], np.cumsum(used)])
    starts = np.cumsum([0] + [len(p) + 2 for p in plain])
    return hashed, before[np.minimum(starts, len(used))]


def has_letter(text: str) -> bool:
    """Whether a character of Unicode's category L is there; fractions and circled numbers are none."""
    return any(mark.group().isalpha() for mark in _WORD_MARK.finditer(text))


@dataclass
class LanguageModel:
    """``log_p[l, g]``: smoothed log probability of trigram bucket ``g`` in language ``l``; 256 KB a language."""

    names: list[str]
    log_p: np.ndarray


def train(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", max_languages: int | None = None, smoothing: float = 0.5
) -> LanguageModel:
    """Count trigrams per language over all rows with a language that are not held out.

    Every language is learned, unless ``max_languages`` is given: then the most frequent ones are (ties: in
    order of name). What reaches the driver is one count per language and trigram bucket that occurs.
    Rows with a null language or text, or held out, teach nothing; repeated rows count each; an empty
    table, or one without a usable row, gives a model without languages. Other columns are ignored.
    """
    labelled = docs.filter(F.col(lang).isNotNull() & F.col(text).isNotNull() & ~held_out(F.col(doc_id))).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    top = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang")
    names = sorted(r.lang for r in (top if max_languages is None else top.limit(max_languages)).collect())
    place = {name: i for i, name in enumerate(names)}

    def count(batches):
        import pyarrow as pa

        # Counts of a few languages are added up in the task, those of many slice by slice.
        totals = np.zeros(len(names) * BUCKETS if len(names) <= 64 else 0, np.int64)
        for batch in batches:
            for start, stop in slices(batch.column(1), SLICE):
                part = batch.slice(start, stop - start)
                found, bounds = grams(plain_bytes(part.column(1)))
                row = np.repeat([place.get(x, -1) for x in part.column(0).to_pylist()], np.diff(bounds))
                known = row >= 0
                flat = row[known].astype(np.int64) * BUCKETS + found[known]
                if len(totals):
                    totals += np.bincount(flat, minlength=len(totals))
                else:
                    at, n = np.unique(flat, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(n)], ["cell", "n"])
        at = np.flatnonzero(totals)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(totals[at])], ["cell", "n"])

    counts = np.zeros((len(names), BUCKETS))
    if names:
        cells = labelled.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).toPandas()
        counts.ravel()[cells.cell.to_numpy()] = cells.n.to_numpy()
    total = counts.sum(axis=1, keepdims=True)
    return LanguageModel(names, np.log((counts + smoothing) / (total + smoothing * BUCKETS)).astype(np.float32))


def mixture(p: np.ndarray, steps: int, start: np.ndarray | None = None) -> tuple[np.ndarray, float]:
    """Proportions of the rows of ``p`` (languages x trigrams) by EM, and their log likelihood."""
    share = np.full(len(p), 1 / len(p)) if start is None else start / start.sum()
    for _ in range(steps):
        drawn = share[:, None] * p
        share = (drawn / drawn.sum(axis=0)).mean(axis=1)
    return share, float(np.log(share @ p).sum())


def mixtures(p: np.ndarray, bounds: np.ndarray, steps: int) -> np.ndarray:
    """EM for many documents at once: ``p`` is languages x trigrams, documents lie between bounds."""
    sizes = np.diff(bounds)
    full = np.flatnonzero(sizes)
    share = np.full((len(p), len(full)), 1 / len(p), np.float32)
    for _ in range(steps):
        drawn = np.repeat(share, sizes[full], axis=1)
        drawn *= p
        drawn /= drawn.sum(axis=0)
        share = np.add.reduceat(drawn, bounds[:-1][full], axis=1) / sizes[full]
    result = np.zeros((len(p), len(sizes)), np.float32)
    result[:, full] = share
    return result


def identify(
    docs: DataFrame,
    model: LanguageModel,
    text: str = "text",
    out: str = "language",
    penalty: float = 4.0,
    screen: float = 0.02,
    steps: int = 6,
    more_steps: int = 25,
) -> DataFrame:
    """``docs`` with a struct ``out`` of (lang_pred, score, langs, shares).

    ``langs`` are the chosen languages by falling share, ``lang_pred`` the first. ``score`` is its
    share, or for a single language its posterior against the other single languages. Each language
    after the first costs ``penalty * log(trigrams)``; languages below ``screen`` after ``steps`` of
    EM over all languages are not tried.

    Text that is null or has no letter gives ``und`` with score 0, as does everything if nothing
    was learned. Only the text is looked at; repeated rows are marked each; an empty table gives an
    empty table. Columns of any name are carried through; should ``out`` be taken, underscores are
    added to it.
    """
    sent = Sent(docs.sparkSession, model)

    def predict(values):
        names, log_p = sent.value.names, sent.value.log_p
        found, bounds = grams(values)
        chosen: list[tuple] = [(UNKNOWN, 0.0, [], [])] * len(values)
        if not names:
            return list(zip(*chosen))
        per_round = max(1, ROUND // (4 * len(names)))
        first = 0
        while first < len(values):
            last = max(first + 1, int(np.searchsorted(bounds, bounds[first] + per_round, "right")) - 1)
            own, limits = log_p[:, found[bounds[first] : bounds[last]]], bounds[first : last + 1] - bounds[first]
            p = np.exp(own)
            shares = mixtures(p, limits, steps)
            for i in range(last - first):
                value, (a, b) = values[first + i], limits[i : i + 2]
                if value and a < b and has_letter(value.decode("utf-8", "replace")):
                    chosen[first + i] = _choose(names, own[:, a:b], p[:, a:b], shares[:, i])
            first = last
        return list(zip(*chosen))

    def _choose(names, log_p, p, share):
        single = log_p.sum(axis=1, dtype=np.float64)
        best = int(single.argmax())
        score, picked, parts = float(1 / np.exp(single - single[best]).sum()), [best], [1.0]
        top, cost = single[best], penalty * np.log(p.shape[1] + 1)
        order = [int(l) for l in np.argsort(-share, kind="stable") if share[l] >= screen]
        for size in range(2, len(order) + 1):
            part, likelihood = mixture(p[order[:size]].astype(np.float64), more_steps, share[order[:size]].astype(np.float64))
            if likelihood - cost * (size - 1) <= top:
                break
            top = likelihood - cost * (size - 1)
            ranked = np.argsort(-part, kind="stable")
            picked, parts = [order[i] for i in ranked], [float(part[i]) for i in ranked]
            score = parts[0]
        return names[picked[0]], min(1.0, score), [names[i] for i in picked], parts

    fields = "lang_pred string, score double, langs array<string>, shares array<double>"
    return append_struct(docs, text, free_name(docs, out), fields, lambda v: predict(v) if v else [[], [], [], []], limit=SLICE)
