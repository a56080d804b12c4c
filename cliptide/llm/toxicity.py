"""Toxicity scores: gradient-boosted trees over dense text features, calibrated isotonically.

The lexicon is learned from the labelled rows: words, and stems that begin words, whose share of
toxic documents is far above that of the rest. Features are lexicon densities, hits near a second person, capitals, punctuation
and obfuscation rates. Trees are fitted on two of the three learning folds and calibrated on the
third.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import Sent, append_struct, free_name, held_out
from cliptide.operators.exact import settled, small_table

#: Rows a model is fitted on at most (in expectation); which ones depends on a hash of the id alone.
MAX_ROWS = 30_000
MAX_LEXICON = 300
THRESHOLD = 0.3
NEAR = 3

#: Stems of so many letters are learned, so that inflected words are known too; "*" marks a stem.
STEMS = range(4, 9)

SECOND_PERSON = frozenset("you your yours yourself u ur du dich dir dein deine tu te toi ton ta vous votre tú tus usted ustedes".split())
LEET = str.maketrans("013457@$!", "oieastasi")

_WORD = re.compile(r"[^\W\d_]+")
_MIXED = re.compile(r"[^\W\d_]+(?:[0-9@$!*]+[^\W\d_]+)+")

#: 1 for letters, 2 for what may stand for one, 0 for the rest.
_KINDS = np.array([1 if chr(c).isalpha() and c < 128 or c >= 128 else 2 if chr(c) in "0123456789@$!*" else 0 for c in range(256)], np.uint8)

FEATURES = [
    "hits_per_word", "weight_per_word", "log_hits", "top_weight", "distinct_hits", "near_second_person",
    "second_person", "capitals", "shouted", "exclamations", "questions", "punctuation", "digits",
    "mixed_words", "disguised_hits", "repeats", "log_words",
]


class Lexicon:
    """Weights of words and stems; a word has that of its longest entry."""

    def __init__(self, entries: dict[str, float]):
        self.entries = entries
        self.begins = {e[: STEMS[0]] for e in entries if e.endswith("*")}
        #: How words begin that may be an entry or a second person.
        self.gate = {w[: STEMS[0]] for w in (*entries, *SECOND_PERSON)}

    def find(self, word: str) -> str | None:
        if word in self.entries:
            return word
        if word[: STEMS[0]] in self.begins:
            for size in reversed(STEMS):
                if len(word) > size and (stem := word[:size] + "*") in self.entries:
                    return stem
        return None


def features(value: bytes | None, lexicon: Lexicon) -> list[float]:
    """The dense features of one text, in the order of ``FEATURES``."""
    text = (value or b"").decode("utf-8", "replace")
    lowered = text.lower()
    words = _WORD.findall(lowered)
    n, hits, persons = max(1, len(words)), [], []
    gate, size = lexicon.gate, STEMS[0]
    for i in [i for i, word in enumerate(words) if word[:size] in gate]:
        if lexicon.find(words[i]):
            hits.append(i)
        elif words[i] in SECOND_PERSON:
            persons.append(i)
    weights = [lexicon.entries[lexicon.find(words[i])] for i in hits]
    places = np.array(persons, float)
    near = sum(bool(len(places)) and np.abs(places - i).min() <= NEAR for i in hits)
    cells = np.frombuffer(value or b"", np.uint8)
    kind = _KINDS[cells]
    runs = kind[np.flatnonzero(np.diff(kind, prepend=np.uint8(3)))]
    inside = (runs[1:-1] == 2) & (runs[:-2] == 1) & (runs[2:] == 1) if len(runs) > 2 else np.zeros(0, bool)
    mixed = _MIXED.findall(lowered) if inside.any() else []
    disguised = sum(lexicon.find(m.translate(LEET).replace("*", "")) is not None for m in mixed)
    size = max(1, len(cells))
    counts = np.bincount(cells, minlength=256)
    upper, lower, digits = counts[65:91].sum(), counts[97:123].sum(), counts[48:58].sum()
    marks = counts[33:127].sum() - upper - lower - digits
    capital = (cells >= 65) & (cells <= 90)
    three = capital[:-2] & capital[1:-1] & capital[2:] if len(cells) > 2 else capital[:0]
    shouted = int(three[:1].sum() + (three[1:] & ~three[:-1]).sum())
    repeats = ((cells[2:] == cells[1:-1]) & (cells[1:-1] == cells[:-2])).sum() if len(cells) > 2 else 0
    return [float(x) for x in (
        100 * len(hits) / n, 100 * sum(weights) / n, np.log1p(len(hits)), max(weights, default=0.0), len({words[i] for i in hits}), near,
        100 * len(persons) / n, upper / max(1, upper + lower), 100 * shouted / n, 100 * counts[33] / size,
        100 * counts[63] / size, 100 * marks / size, 100 * digits / size,
        100 * len(mixed) / n, disguised, 100 * repeats / size, np.log1p(len(words)),
    )]


def with_features(docs: DataFrame, lexicon: dict[str, float], text: str, out: str) -> DataFrame:
    sent = Sent(docs.sparkSession, Lexicon(lexicon))
    return append_struct(docs, text, out, "values array<double>", lambda vs: ([features(v, sent.value) for v in vs],))


@dataclass
class ToxicityModel:
    """A learned lexicon, trees and a calibration; without two classes only the share of toxic rows."""

    lexicon: dict[str, float]
    share: float
    trees: Any = None
    calibration: Any = None


def learn_lexicon(rows: DataFrame, limit: int = MAX_LEXICON, least: int = 5, sure: float = 4.0) -> dict[str, float]:
    """Words and stems of (text, toxic) rows whose log odds of toxic are over ``sure`` standard errors above all others."""
    words = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(r"(\p{L}+)"), F.lit(1)))
    stems = [F.transform(F.filter(words, lambda w, k=k: F.length(w) > k), lambda w, k=k: F.concat(F.substring(w, 1, k), F.lit("*"))) for k in STEMS]
    words = rows.select("toxic", F.explode(F.array_distinct(F.concat(words, *stems))).alias("word"))
    totals = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    total, toxic = float(totals[0]), float(totals[1] or 0)
    t, n = F.sum("toxic").cast("double"), F.count(F.lit(1)).cast("double")
    odds = F.log((F.col("t") + 0.5) / (F.lit(toxic) - F.col("t") + 0.5)) - F.log(
        (F.col("n") - F.col("t") + 0.5) / (F.lit(total - toxic) - F.col("n") + F.col("t") + 0.5)
    )
    spread = F.sqrt(1 / (F.col("t") + 0.5) + 1 / (F.col("n") - F.col("t") + 0.5))
    found = (
        words.groupBy("word").agg(t.alias("t"), n.alias("n")).filter(F.col("t") >= least)
        .select("word", odds.alias("odds"), (odds / spread).alias("sure")).filter(F.col("sure") > sure)
        .orderBy(F.desc("sure"), "word").limit(limit).collect()
    )
    return {r.word: float(r.odds) for r in found}


def _vector(values: Column) -> Column:
    return array_to_vector(values)


def train(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", max_rows: int = MAX_ROWS, seed: int = 7
) -> ToxicityModel:
    """Fit on labelled rows that are not held out, about ``max_rows`` of them if there are more.

    Of labels that repeat an id the largest counts; labels without id or value are left out.
    """
    marked = (
        labels.filter(F.col(doc_id).isNotNull() & F.col(toxic).isNotNull() & ~held_out(F.col(doc_id)))
        .groupBy(F.col(doc_id).alias("doc_id")).agg(F.max(F.col(toxic).cast("int")).alias("toxic"))
    )
    count = marked.count()
    if count > max_rows:
        marked = marked.filter(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(1_000_000 * max_rows / count))
    rows = settled(
        docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).join(small_table(marked, 2 * max_rows), "doc_id"),
        "toxic_rows",
    )
    total, positive = rows.agg(F.count(F.lit(1)), F.sum("toxic")).first()
    share = float(positive or 0) / total if total else 0.0
    if not total or positive in (0, total):
        return ToxicityModel({}, share)
    lexicon = learn_lexicon(rows)
    ready = settled(
        with_features(rows, lexicon, "text", "f").select(
            F.col("toxic").cast("double").alias("label"), "f.values",
            (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 3).alias("calibrates"),
        ),
        "toxic_features",
    ).select("label", _vector(F.col("values")).alias("features"), "calibrates")
    fit, check = ready.filter("NOT calibrates"), ready.filter("calibrates")
    if fit.select("label").distinct().count() < 2 or check.select("label").distinct().count() < 2:
        fit, check = ready, None
    trees = GBTClassifier(maxIter=20, maxDepth=3, stepSize=0.2, maxBins=64, minInstancesPerNode=5, seed=seed).fit(fit)
    if check is None:
        return ToxicityModel(lexicon, share, trees)
    raw = trees.transform(check).select("label", vector_to_array("probability")[1].alias("raw"))
    return ToxicityModel(lexicon, share, trees, IsotonicRegression(featuresCol="raw", predictionCol="calibrated").fit(raw))


def score(docs: DataFrame, model: ToxicityModel, text: str = "text", out: str = "toxicity", threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with a struct ``out`` of (score, predicted, features).

    Only the text is looked at. A null text counts as empty; an empty text has a score too. If
    there was nothing to learn from, every score is the share of toxic rows (0 without any).
    Repeated rows are scored each; an empty table gives an empty table. Columns of any name are
    carried through; should ``out`` be taken, underscores are added to it.
    """
    out = free_name(docs, out)
    wrapped = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))
    ready = with_features(wrapped, model.lexicon, "_text", "_f").drop("_text").withColumn("features", _vector(F.col("_f.values")))
    chance = F.lit(model.share)
    if model.trees is not None:
        ready = model.trees.transform(ready).withColumn("raw", vector_to_array("probability")[1])
        chance = F.col("raw")
        if model.calibration is not None:
            ready = model.calibration.transform(ready)
            chance = F.col("calibrated")
    chance = F.greatest(F.lit(0.0), F.least(F.lit(1.0), chance))
    result = F.struct(chance.alias("score"), (chance >= threshold).cast("int").alias("predicted"), F.col("_f.values").alias("features"))
    return ready.select("_doc.*", result.alias(out))
