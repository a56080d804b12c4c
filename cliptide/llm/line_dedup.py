"""Line de-duplication over levelled sorted runs of line hashes. Spark functions and SQL only.

The corpus is taken in batches of descending document id. A batch is aggregated to one entry per
line key and merge-joined with every run written so far: a key no run knows is new, and this batch
gives its holder; a known key adds only its count. The entries form a new sorted run. When
``fan_in`` runs stand on a level they are compacted into one run on the next, so that an entry is
rewritten once per level. Runs are bucketed and sorted by key: neither the merge-joins nor the
compactions shuffle them again.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.llm.common import ASCII_SPACE, ascii_lower, free_name, unique
from cliptide.operators.exact import settled
from cliptide.session import remove, scratch_path

KEY = ["h1", "h2"]


@dataclass
class LineRuns:
    """Sorted runs of (h1, h2, n, holder), by level."""

    spark: SparkSession
    fan_in: int = 2
    levels: list[list[str]] = field(default_factory=list)
    paths: dict[str, str] = field(default_factory=dict)

    def __post_init__(self) -> None:
        self.buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))

    def _write(self, entries: DataFrame, level: int) -> None:
        name = unique("line_run")
        self.paths[name] = scratch_path(self.spark, name)
        (
            entries.write.bucketBy(self.buckets, *KEY).sortBy(*KEY)
            .option("path", self.paths[name]).format("parquet").saveAsTable(name)
        )
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append(name)

    def runs(self) -> list[str]:
        return [name for level in self.levels for name in level]

    def add(self, lines: DataFrame) -> None:
        """Merge one batch of (h1, h2, doc_id) and compact the levels that are full."""
        entries = lines.groupBy(*KEY).agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("holder"))
        known: Column = F.lit(False)
        for i, name in enumerate(self.runs()):
            run = self.spark.table(name).select(*KEY, F.lit(True).alias(f"in_{i}"))
            entries = entries.join(run.hint("merge"), KEY, "left")
            known = known | F.col(f"in_{i}").isNotNull()
        holder = F.when(~known, F.col("holder")).alias("holder")
        self._write(entries.select(*KEY, "n", holder), 0)
        for level in range(len(self.levels) + 1):
            if level < len(self.levels) and len(self.levels[level]) >= self.fan_in:
                full, self.levels[level] = self.levels[level], []
                self._write(self._merged(full), level + 1)
                self._drop(full)

    def _merged(self, runs: list[str]) -> DataFrame:
        rows = self.spark.table(runs[0])
        for name in runs[1:]:
            run = self.spark.table(name).withColumnsRenamed({"n": "more", "holder": "other"})
            rows = rows.join(run.hint("merge"), KEY, "full").select(
                *KEY, (F.coalesce("n", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("n"), F.greatest("holder", "other").alias("holder")
            )
        return rows

    def merged(self) -> DataFrame:
        return self._merged(self.runs())

    def _drop(self, runs: list[str]) -> None:
        for name in runs:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
            remove(self.spark, self.paths.pop(name))

    def close(self) -> None:
        """Drop all runs, those too that a failure has left between two levels."""
        self._drop(list(self.paths))
        self.levels = []


def line_keys(text: Column) -> Column:
    """Per line: ASCII white space stripped at both ends, A-Z lower-cased."""
    lines = F.split(ascii_lower(F.coalesce(text, F.lit(""))), "\n", -1)
    return F.transform(lines, lambda line: F.btrim(line, F.lit(ASCII_SPACE)))


def _in_sorted(value: Column, items: Column) -> Column:
    """Binary search in a sorted array, so that a document of many lines stays linear."""
    steps = F.filter(F.array(*[F.lit(1 << i) for i in range(30, -1, -1)]), lambda s: s <= F.size(items))
    at = F.aggregate(
        steps, F.lit(0),
        lambda at, step: F.when((at + step <= F.size(items)) & (F.get(items, at + step - 1) <= value), at + step).otherwise(at),
    )
    return F.coalesce(F.get(items, at - 1) == value, F.lit(False))


def dedup_lines(
    docs: DataFrame,
    doc_id: str = "doc_id",
    text: str = "text",
    min_chars: int = 20,
    min_docs: int = 3,
    batches: int = 4,
    fan_in: int = 2,
    out: str = "lines",
) -> DataFrame:
    """``docs`` with a struct ``out`` of (n_lines, n_dropped, kept).

    A line key of at least ``min_chars`` code points that occurs in at least ``min_docs`` rows
    keeps its lines only in the largest id that holds it; other lines stay, joined by newline.

    A null or empty text is one empty line. Rows that share an id each count as a document, and
    all rows of the largest id keep the line. Rows with a null id count too but hold a line only
    if every row with that line has a null id. An empty table gives an empty table. Columns of
    any name are carried through; should ``out`` be taken, underscores are added to it.
    """
    spark = docs.sparkSession
    shared = (F.length("key") >= min_chars) & F.col("key").isNotNull()
    keys = docs.select(F.col(doc_id).alias("doc_id"), F.explode(F.array_distinct(line_keys(F.col(text)))).alias("key"))
    first = F.xxhash64("key")
    lines = settled(
        keys.filter(shared).select("doc_id", first.alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2")), "line_keys"
    )
    cuts = lines.agg(F.percentile_approx("doc_id", [i / batches for i in range(batches - 1, 0, -1)])).first()[0] or []
    runs = LineRuns(spark, fan_in)
    try:
        upper = None
        for low in [*dict.fromkeys(cuts), None]:
            batch = lines
            if low is not None:
                batch = batch.filter(F.col("doc_id") > low)
            if upper is not None:
                below = F.col("doc_id") <= upper
                batch = batch.filter(below if low is not None else below | F.col("doc_id").isNull())
            runs.add(batch)
            upper = low
        common = settled(runs.merged().filter(F.col("n") >= min_docs), "common_lines")
    finally:
        runs.close()
    lost = (
        lines.join(common.select(*KEY, "holder"), KEY)
        .filter(~F.col("doc_id").eqNullSafe(F.col("holder")))
        .groupBy(F.col("doc_id").alias("_lost_id"))
        .agg(F.sort_array(F.collect_list("h1")).alias("_lost"))
    )
    marked = docs.select(F.struct(*docs.columns).alias("_doc")).join(
        lost, F.col(f"_doc.{doc_id}").eqNullSafe(F.col("_lost_id")), "left"
    )
    whole = F.coalesce(F.col(f"_doc.{text}"), F.lit(""))
    split = F.split(whole, "\n", -1)
    flags = F.transform(
        line_keys(whole),
        lambda key: (F.length(key) >= min_chars) & _in_sorted(F.xxhash64(key), F.col("_lost")),
    )
    # The transform names the flags, so that no plan evaluates them once for every line.
    cut = F.transform(F.array(flags), lambda lost: F.struct(
        F.size(F.filter(lost, lambda x: x)).alias("n"),
        F.array_join(F.filter(split, lambda line, i: ~F.get(lost, i)), "\n").alias("kept"),
    ))[0]
    clean = F.col("_lost").isNull()
    marked = marked.withColumn("_cut", F.when(~clean, cut))
    result = F.struct(
        F.size(split).cast("long").alias("n_lines"),
        F.when(clean, F.lit(0)).otherwise(F.col("_cut.n")).cast("long").alias("n_dropped"),
        F.when(clean, whole).otherwise(F.col("_cut.kept")).alias("kept"),
    )
    return marked.select("_doc.*", result.alias(free_name(docs, out)))
