"""How far the sources of a language differ in their words: an audit by three-dimensional cube partitioning.

The groups (sources) of a language are dealt into blocks, and so are its terms. A task owns one cell (group
block, group block, term block): it gets the slices of both group blocks for its term block and sums up the
differences of its pairs of groups over its terms. A slice is copied once for each cell that
needs it, not once for each pair; the partial sums are then added along the term axis. Cells have a bounded
number of groups and terms whatever the size of the corpus.

Shares are whole numbers, ``1 + floor(10**9 * (count + 5) / (total + 5 * terms))``, and all arithmetic is exact.
"""

from __future__ import annotations

import re

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cliptide.llm.common import SLICE, plain_bytes, slices
from cliptide.operators.exact import attach, settled

MIN_DOCS = 30
TOP = 50
#: Groups and terms in a block.
GROUPS, TERMS = 32, 8192
PSEUDO, SCALE = 5, 1_000_000_000
#: Distinct (group, term) entries that a task holds before it passes its counts on.
HELD = 300_000

_TERM = re.compile(rb"[a-z\x80-\xff]+")


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, count, docs): occurrences and documents of each term by group, summed up in
    the tasks before anything is shuffled. Every group also has one row with an empty term and no count."""

    def run(batches):
        from collections import Counter, defaultdict

        import pyarrow as pa

        def empty():
            return defaultdict(lambda: (Counter(), Counter()))

        def flush(held):
            for (lang, source), (counts, files) in held.items():
                terms = list(counts)
                n = len(terms) + 1
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * n, pa.string()), pa.array([source] * n, pa.string()), pa.array([b"", *terms], pa.binary()).cast(pa.string()),
                        pa.array([0, *(counts[t] for t in terms)], pa.int64()), pa.array([0, *(files[t] for t in terms)], pa.int64()),
                    ],
                    ["lang", "source", "term", "count", "docs"],
                )

        held, size = empty(), 0
        for batch in batches:
            for start, stop in slices(batch.column("text"), SLICE):
                part = batch.slice(start, stop - start)
                for lang, source, text in zip(part.column("lang").to_pylist(), part.column("source").to_pylist(), plain_bytes(part.column("text"))):
                    counts, files = held[lang, source]
                    before = len(counts)
                    words = _TERM.findall(text.lower())
                    counts.update(words)
                    files.update(set(words))
                    size += len(counts) - before
                if size > HELD:
                    yield from flush(held)
                    held, size = empty(), 0
        yield from flush(held)

    counted = docs.mapInArrow(run, "lang string, source string, term string, count long, docs long")
    return counted.groupBy("lang", "source", "term").agg(F.sum("count").alias("count"), F.sum("docs").alias("docs"))


def share(count: Column, total: Column, terms: Column) -> Column:
    """1 + floor(10**9 * (count + 5) / (total + 5 * terms)), exact for any counts; 0 without terms."""
    wide = lambda c: c.cast("decimal(20,0)")
    over = (wide(count) + PSEUDO) * F.lit(SCALE).cast("decimal(10,0)")
    under = wide(total) + wide(terms) * F.lit(PSEUDO).cast("decimal(2,0)")
    return F.when(terms > 0, 1 + F.call_function("div", over, under)).otherwise(0).cast("long")


class Audit:
    """The counts and shares of one corpus, written once below the checkpoint folder."""

    def __init__(self, docs: DataFrame, min_docs: int = MIN_DOCS, groups: int = GROUPS, terms: int = TERMS):
        read = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
        counts = settled(term_counts(read), "term_counts")
        self.vocabulary = settled(
            counts.filter("term <> ''").groupBy("lang", "term").agg(F.sum("count").alias("total"), F.sum("docs").alias("docs"))
            .filter(F.col("docs") >= min_docs).withColumn("id", F.monotonically_increasing_id()),
            "vocabulary",
        )
        kept = counts.filter("term <> ''").join(self.vocabulary.select("lang", "term", "id", "total"), ["lang", "term"])
        kept = settled(kept.select("lang", "source", "term", "id", "count", "total"), "kept_counts")
        directory = (
            counts.filter("term = ''").select("lang", "source")
            .join(kept.groupBy("lang", "source").agg(F.sum("count").alias("n")), ["lang", "source"], "left")
            .withColumn("n", F.coalesce("n", F.lit(0)))
        )
        sizes = self.vocabulary.groupBy("lang").agg(F.count(F.lit(1)).alias("v"), F.sum("total").alias("lang_n"))
        langs = directory.groupBy("lang").agg(F.count(F.lit(1)).alias("n_groups")).join(sizes, "lang", "left")
        langs = langs.select(
            "lang", F.coalesce("v", F.lit(0)).alias("v"), F.coalesce("lang_n", F.lit(0)).alias("lang_n"),
            F.greatest(F.ceil(F.col("n_groups") / groups), F.lit(1)).cast("int").alias("group_blocks"),
            F.greatest(F.ceil(F.coalesce("v", F.lit(0)) / terms), F.lit(1)).cast("int").alias("term_blocks"),
        )
        self.groups = settled(
            attach(directory, langs, ["lang"])
            .withColumn("none", share(F.lit(0), F.col("n"), F.col("v")))
            .withColumn("block", F.pmod(F.xxhash64("source"), "group_blocks").cast("int")),
            "groups",
        )
        near = self.groups.select("lang", "source", "n", "v", "lang_n", "block", "group_blocks", "term_blocks")
        self.shares = settled(
            attach(kept, near, ["lang", "source"]).select(
                "lang", "source", "block", "group_blocks", F.pmod(F.xxhash64("id"), "term_blocks").cast("int").alias("term_block"), "id", "term",
                share(F.col("count"), F.col("n"), F.col("v")).alias("p"), share(F.col("total"), F.col("lang_n"), F.col("v")).alias("q"),
            ),
            "shares",
        )

    def cells(self) -> DataFrame:
        """(lang, one, other, term_block, block, source, id, p): every slice once for each cell that needs it.
        A group's own row has no id; its p is that of a term it lacks."""
        every = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
        slim = self.shares.select("lang", "source", "block", "group_blocks", "term_block", "id", "p")
        own = self.groups.select("lang", "source", "block", "group_blocks", every(F.col("term_blocks")).alias("term_block"), F.lit(None).cast("long").alias("id"), F.col("none").alias("p"))
        copied = slim.unionByName(own).withColumn("_to", every(F.col("group_blocks")))
        return copied.select("lang", F.least("block", "_to").alias("one"), F.greatest("block", "_to").alias("other"), "term_block", "block", "source", "id", "p")

    def pairs(self) -> DataFrame:
        """(lang, source, item, value): summed differences of any two groups of a language, both ways."""
        partial = self.cells().groupBy("lang", "one", "other", "term_block").applyInPandas(
            _cell, "lang string, a string, b string, sum long, seen long, none_a long, none_b long"
        )
        # A task saw only the terms that one of its groups has; all groups lack the rest.
        summed = partial.groupBy("lang", "a", "b").agg(
            F.sum("sum").alias("sum"), F.sum("seen").alias("seen"), F.first("none_a").alias("none_a"), F.first("none_b").alias("none_b")
        )
        sizes = self.groups.select("lang", "v").distinct()
        value = F.col("sum") + (F.col("v") - F.col("seen")) * F.abs(F.col("none_a") - F.col("none_b"))
        found = attach(summed, sizes, ["lang"]).withColumn("value", value)
        ways = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
        return found.select("lang", ways.alias("way"), "value").select("lang", "way.source", "way.item", "value")

    def terms(self) -> DataFrame:
        """(lang, source, item, value): terms with a larger share in a group than in its language."""
        return self.shares.filter("p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))


def _cell(pdf):
    """Partial sums of the pairs of groups of one cell."""
    import pandas as pd

    lang, one, other = pdf.lang.iloc[0], pdf.one.iloc[0], pdf.other.iloc[0]
    owns = pdf[pdf.id.isna()].sort_values("source")
    names, none = owns.source.to_numpy(), owns.p.to_numpy(np.int64)
    block = owns.block.to_numpy()
    slices_ = pdf[pdf.id.notna()]
    ids, column = np.unique(slices_.id.to_numpy(np.int64), return_inverse=True)
    table = np.repeat(none[:, None], len(ids), axis=1)
    table[np.searchsorted(names.astype(str), slices_.source.to_numpy().astype(str)), column] = slices_.p.to_numpy(np.int64)
    found = []
    for i in range(len(names)):
        # Two different blocks meet; within one block each pair is taken once.
        to = np.flatnonzero(block != block[i]) if one != other else np.arange(i + 1, len(names))
        if one != other and block[i] != one:
            continue
        if len(to):
            sums = np.abs(table[to] - table[i]).sum(axis=1)
            flip = names[to] < names[i]
            found.append(pd.DataFrame({
                "lang": lang, "a": np.where(flip, names[to], names[i]), "b": np.where(flip, names[i], names[to]), "sum": sums, "seen": len(ids),
                "none_a": np.where(flip, none[to], none[i]), "none_b": np.where(flip, none[i], none[to]),
            }))
    if not found:
        return pd.DataFrame(columns=["lang", "a", "b", "sum", "seen", "none_a", "none_b"])
    return pd.concat(found)


def audit(docs: DataFrame, min_docs: int = MIN_DOCS, top: int = TOP, groups: int = GROUPS, terms: int = TERMS) -> DataFrame:
    """(lang, source, part, item, value, rank) of ``docs`` (lang, source, text).

    A term is a run of ASCII letters and other characters beyond ASCII, A-Z lower-cased; each language
    keeps the terms of at least ``min_docs`` of its documents. Part ``pair`` has, for each group (lang,
    source), the summed differences of shares to every other source of the language; part ``term`` the
    ``top`` terms whose share is larger than in the language as a whole. Ranks go by value
    (largest first), then by item.

    Null texts, languages and sources count as empty strings; every row is a document, so repeated rows
    count again. A group without terms has its pairs, of value 0 if the language keeps no term. An empty
    table gives no rows; other columns are ignored, whatever their names.
    """
    made = Audit(docs, min_docs, groups, terms)
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    shape = lambda df, part: df.select("lang", "source", F.lit(part).alias("part"), "item", "value", "rank")
    first = made.terms().withColumn("rank", rank).filter(F.col("rank") <= top)
    return shape(made.pairs().withColumn("rank", rank), "pair").unionByName(shape(first, "term"))
