"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

The windows of the benchmark items are the patterns. A table of two-word blocks tells how far the
search may jump from a position; where it may not, the windows that end in that block and begin
with the same two words are compared with the text word by word.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import Sent, append_struct, free_name
from cliptide.operators.exact import settled

WINDOW = 13
#: Bytes of benchmark text whose tables go to every task; a larger benchmark is searched block by block.
BLOCK_BYTES = 4 << 20

_KEPT = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20
    for c in range(256)
)


def words(text: bytes | None) -> list[bytes]:
    """Runs of ASCII digits and letters (A-Z lower-cased) and all non-ASCII characters."""
    return text.translate(_KEPT).split() if text else []


class Patterns:
    """Wu-Manber tables for windows of one length."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.far = length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.buckets: dict[tuple, dict[tuple, list[tuple[list[bytes], int, str]]]] = {}

    def add(self, item: str, text: list[bytes], start: int) -> None:
        m, b = self.length, self.block
        for end in range(b, m + 1):
            key = tuple(text[start + end - b : start + end])
            self.shift[key] = min(self.shift.get(key, self.far), m - end)
        suffix, prefix = tuple(text[start + m - b : start + m]), tuple(text[start : start + b])
        self.buckets.setdefault(suffix, {}).setdefault(prefix, []).append((text, start, item))

    def search(self, text: list[bytes]):
        """Yield (start, item) of every occurrence."""
        m, b, far, shift = self.length, self.block, self.far, self.shift
        end = m
        while end <= len(text):
            block = tuple(text[end - b : end])
            jump = shift.get(block, far)
            if jump:
                end += jump
                continue
            start = end - m
            for other, at, item in self.buckets[block].get(tuple(text[start : start + b]), ()):
                if text[start:end] == other[at : at + m]:
                    yield start, item
            end += 1


def tables(items: list[tuple[str, str]], window: int = WINDOW) -> list[Patterns]:
    """One set of tables per window length; items shorter than ``window`` are one window each."""
    by_length: dict[int, Patterns] = {}
    for item, text in items:
        found = words(text.encode("utf-8"))
        length = min(len(found), window)
        if length:
            patterns = by_length.setdefault(length, Patterns(length))
            for start in range(len(found) - length + 1):
                patterns.add(item, found, start)
    return list(by_length.values())


def covered(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping or touching spans joined."""
    joined: list[tuple[int, int]] = []
    for start, stop in sorted(spans):
        if joined and start <= joined[-1][1]:
            joined[-1] = (joined[-1][0], max(stop, joined[-1][1]))
        else:
            joined.append((start, stop))
    return joined


FIELDS = "n_words long, n_hit long, spans array<struct<start: int, stop: int>>, items array<string>"


def mark_contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    out: str = "found",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``docs`` with a struct ``out`` of (n_words, n_hit, spans, items, items_sha256, contaminated).

    ``spans`` are the hit words as joined half-open ranges, ``items`` the ids (as strings, sorted)
    of the items with a window in the document. A document is contaminated if at least a twentieth
    of its words, and at least one, are hit.

    A null or empty text has no words and is clean; items without words or id match nothing;
    items that share an id count once. Repeated documents are marked each. Empty tables work on
    either side. Columns of any name are carried through; should ``out`` be taken, underscores are
    added to it. Only blocks of at most about ``block_bytes`` of benchmark text are broadcast; of a
    larger benchmark each block is searched in turn and its spans are added.
    """
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_id).cast("string").alias("item"), F.col(item_text).alias("text")).dropna()
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // block_bytes))
    out = free_name(docs, out)
    marked = docs
    for block in range(blocks):
        chosen = items if blocks == 1 else items.filter(F.pmod(F.xxhash64("item"), F.lit(blocks)) == block)
        sent = Sent(spark, tables([tuple(r) for r in chosen.collect()], window))

        def search(values, sent=sent):
            rows = []
            for value in values:
                found = words(value)
                hits = [(start, start + p.length, item) for p in sent.value for start, item in p.search(found)]
                spans = covered([h[:2] for h in hits])
                rows.append((
                    len(found), sum(b - a for a, b in spans),
                    [{"start": a, "stop": b} for a, b in spans], sorted({h[2] for h in hits}),
                ))
            return list(zip(*rows)) if rows else [[], [], [], []]

        part = append_struct(marked, text, free_name(marked, out if not block else "_found_more"), FIELDS, search)
        if block:
            part = _added(part, out, part.columns[-1])
        marked = part if block == blocks - 1 else settled(part, "contaminated")
    found = F.col(out)
    listed = F.array_join(found["items"], ",")
    return marked.withColumn(out, F.struct(
        found["n_words"].alias("n_words"), found["n_hit"].alias("n_hit"), found["spans"].alias("spans"), found["items"].alias("items"),
        F.sha2(listed.cast("binary"), 256).alias("items_sha256"),
        ((found["n_hit"] > 0) & (20 * found["n_hit"] >= found["n_words"])).alias("contaminated"),
    ))


def _added(df: DataFrame, one: str, other: str) -> DataFrame:
    """The findings of two blocks of the benchmark as one."""

    @F.udf(FIELDS)
    def both(a, b):
        spans = covered([tuple(s) for s in [*a["spans"], *b["spans"]]])
        return a["n_words"], sum(y - x for x, y in spans), spans, sorted({*a["items"], *b["items"]})

    return df.withColumn(one, both(one, other)).drop(other)
