"""License scans: MinHash bands over overlapping text windows, then exact shingle containment.

Spark functions only. Templates are classed by their number of shingles: one shingle, up to 16, up to
256, and so on (``SPREAD``). For a class of at most ``c`` shingles the documents' shingles are cut into blocks
of ``c``; a window is two neighbouring blocks, so windows overlap by half and any stretch of ``c`` shingles
lies within one. Template and block are signed alike by one-permutation MinHash: a shingle's hash
falls into one of the class's bins by its leading bits, the smallest of each bin is one band of one value. The
smaller of two blocks' values per bin is the window's, so that looking up the values of both blocks
retrieves whatever the window's would.

``bins_for`` takes the fewest bins with which a window that holds the wanted share of any template of the class
has a band in common with it with a probability of at least ``1 - MISS``. A template with one shingle needs no
bins: block and window are that shingle. Templates retrieved for a document are compared with its whole
text, by exact shingles.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import lru_cache
from math import ceil

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cliptide.llm.common import ascii_lower

#: Words in a shingle; a template of fewer is one shingle of its own length.
SHINGLE = 5
CONTAINMENT = 0.8
#: Largest template of a class of templates by that of the class before.
SPREAD = 16
#: Largest probability that no band of a window agrees with a template's.
MISS = 1e-6
#: Templates searched for in one pass over the documents.
PER_PASS = 64

#: Common notices and whole license texts.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("All-rights-reserved", "All rights reserved."),
    (
        "MIT-text",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
        'documentation files (the "Software"), to deal in the Software without restriction, including without limitation the '
        "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
        "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
        "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
        '"AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF '
        "MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS "
        "BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, "
        "OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    ),
    (
        "ISC-text",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED "
        '"AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF '
        "MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL "
        "DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
)


def words(text: Column) -> Column:
    """Runs of ASCII digits and letters (A-Z lower-cased) and all other non-ASCII characters."""
    spaced = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", " ")
    return F.split(F.trim(spaced), " ")  # no word at all: one empty word


def _starts(items: Column, size: int | Column = SHINGLE) -> Column:
    """Where shingles of ``size`` begin, from 0; none if there are too few words."""
    count = F.size(items) - size + 1
    return F.when(count > 0, F.sequence(F.lit(0), count - 1)).otherwise(F.array().cast("array<int>"))


def shingles(items: Column, size: int | Column = SHINGLE) -> Column:
    return F.transform(_starts(items, size), lambda i: F.array_join(F.slice(items, i + 1, size), " "))


def _word_hashes(items: Column) -> Column:
    return F.transform(items, lambda w: F.xxhash64(w))


def _hashes(words_: Column, size: int) -> Column:
    """A hash per shingle, from the hashes of its words."""
    every = F.transform(words_, lambda h, i: F.xxhash64(h, *[F.get(words_, i + k) for k in range(1, size)]))
    return F.slice(every, F.lit(1), F.greatest(F.size(words_) - size + 1, F.lit(0)))


def _signature(hashes: Column, bits: int) -> Column:
    """Smallest hash of each of ``2 ** bits`` bins; the bin is the leading bits, so sorting brings a bin together."""
    bin_of = lambda h: F.shiftright(h, 64 - bits)
    # The outer transform only names the sorted array, which would be sorted again for every element.
    firsts = F.transform(
        F.array(F.sort_array(hashes)), lambda s: F.filter(s, lambda h, i: (i == 0) | (bin_of(h) != bin_of(F.get(s, i - 1))))
    )
    return firsts[0]


def _retrieved(hashes: Column, most: int, bits: int, wanted: Column) -> Column:
    """The values among ``wanted`` in the signatures of blocks of ``most`` shingles."""
    begins = F.when(F.size(hashes) > 0, F.sequence(F.lit(0), F.size(hashes) - 1, F.lit(most))).otherwise(F.array().cast("array<int>"))
    return F.flatten(F.transform(begins, lambda b: F.array_intersect(_signature(F.slice(hashes, b + 1, most), bits), wanted)))


def class_of(count: int) -> int:
    """Most shingles of a template in the class of one with ``count``: 1, 16, 256, ..."""
    most = 1
    while most < count:
        most *= SPREAD
    return most


def miss(count: int, most: int, bins: int, containment: float = CONTAINMENT) -> float:
    """Probability, or a bound on it, that a window of ``2 * most`` distinct shingles that holds the wanted share of a
    template's ``count`` has no band in common with it.

    ``n`` bins that are not empty hold a random n of the union's shingles; missed are the cases in which
    none of these is common. n follows from throwing the union into the bins.
    """
    window = 1 if most == 1 else 2 * most
    common = ceil(containment * count - 1e-9)
    union = window + count - common
    if union <= 2048:
        odds = np.zeros(min(union, bins) + 1)
        odds[0] = 1.0
        filled = np.arange(len(odds)) / bins
        for _ in range(union):
            odds = odds * filled + np.concatenate([[0.0], (odds * (1 - filled))[:-1]])
        slack, places = 0.0, np.arange(len(odds))
    else:  # n changes by at most 1 with one shingle: below this with a probability of at most ``slack``
        slack = MISS / 4
        least = bins * -np.expm1(union * np.log1p(-1 / bins)) - (union * np.log(1 / slack) / 2) ** 0.5
        odds, places = np.ones(1), np.array([max(int(least), 0)])
    without = np.ones(len(places))
    for k in range(common):
        without *= np.clip((union - places - k) / (union - k), 0, 1)
    return float(slack + odds @ without)


@lru_cache
def bins_for(most: int, least: int, containment: float = CONTAINMENT) -> int:
    """Bits of the fewest bins (a power of two) that keep ``miss`` below ``MISS`` for templates of ``least`` to ``most``."""
    tried = sorted({least, most, *np.linspace(least, most, 16).astype(int).tolist()})
    bits = 1
    while most > 1 and max(miss(t, most, 2**bits, containment) for t in tried) > MISS:
        bits += 1
    return bits


def scan(
    docs: DataFrame,
    templates: Sequence[tuple[str, str]] = NOTICES,
    doc_id: str = "doc_id",
    text: str = "text",
    containment: float = CONTAINMENT,
) -> DataFrame:
    """(doc_id, license, containment, first_word) of every template found in a document.

    ``containment`` is the share of the template's distinct shingles in the document, at least the
    given one; ``first_word`` (from 0) is where the first of them begins. A template of fewer than five
    words is one shingle, found where all its words stand; one without a word is refused.

    Null, empty and short texts match nothing. Rows that share an id are reported as one, with the
    largest containment and the first place. Empty tables give no rows; other columns are
    ignored. Templates are searched for in passes of ``PER_PASS``, each a scan without a shuffle of
    texts.
    """
    spark = docs.sparkSession
    found = None
    for first in range(0, len(templates), PER_PASS):
        part = _scan(docs, spark.createDataFrame(list(templates[first : first + PER_PASS]), "license string, body string"), doc_id, text, containment)
        found = part if found is None else found.unionByName(part)
    if found is None:
        raise ValueError("no templates")
    return found


def _longs(values) -> Column:
    return F.array(*[F.lit(v) for v in values]) if values else F.array().cast("array<bigint>")


def _scan(docs: DataFrame, templates: DataFrame, doc_id: str, text: str, containment: float) -> DataFrame:
    known = templates.select("license", words(F.col("body")).alias("w")).withColumn("size", F.least(F.size("w"), F.lit(SHINGLE)))
    known = [
        (r.license, r.size, r.own)
        for r in known.select("license", "size", F.array_distinct(shingles(F.col("w"), F.col("size"))).alias("own")).collect()
    ]
    if any(own == [""] for _, _, own in known):
        raise ValueError(f"templates without a word: {[name for name, _, own in known if own == ['']]}")
    classes: dict[tuple[int, int], list[int]] = {}
    for i, (_, size, own) in enumerate(known):
        classes.setdefault((size, class_of(len(own))), []).append(i)

    rows = docs.select(F.col(doc_id).alias("doc_id"), words(F.col(text)).alias("w")).withColumn("g", _word_hashes(F.col("w")))
    for size in sorted({size for size, _ in classes}):
        rows = rows.withColumn(f"h{size}", _hashes(F.col("g"), size))
    bands: dict[int, list[int]] = {}
    found = []
    for (size, most), members in classes.items():
        bits = bins_for(most, min(len(known[i][2]) for i in members), containment)
        bands |= _template_bands(templates, known, members, size, bits)
        wanted = _longs(sorted({v for i in members for v in bands[i]}))
        h = F.col(f"h{size}")
        if most == 1:
            found.append(F.array_intersect(h, wanted))
            continue
        found.append(_retrieved(h, most, bits, wanted))
    table = F.array(*[
        F.struct(
            F.lit(name).alias("license"), F.lit(size).alias("size"), F.array(*[F.lit(s) for s in own]).alias("own"), _longs(bands[i]).alias("bands")
        )
        for i, (name, size, own) in enumerate(known)
    ])
    # Conditions stand behind an explode: a filter on a computed array would be pushed down and compute it again.
    retrieved = rows.select("doc_id", "w", F.concat(*found).alias("v"))
    pairs = retrieved.select("doc_id", "w", F.explode(F.filter(table, lambda t: F.arrays_overlap(t["bands"], F.col("v")))).alias("t"))
    held = pairs.withColumn("s", shingles(F.col("w"), F.col("t.size")))
    held = held.select("doc_id", "t", "s", F.explode(F.array(F.array_intersect("s", "t.own"))).alias("common"))
    hits = held.filter(F.size("common") >= containment * F.size("t.own")).select(
        "doc_id", F.col("t.license").alias("license"), (F.size("common") / F.size("t.own")).alias("share"),
        (F.array_min(F.transform("common", lambda c: F.array_position(F.col("s"), c))) - 1).alias("at"),
    )
    return hits.groupBy("doc_id", "license").agg(F.max("share").alias("containment"), F.min("at").cast("long").alias("first_word"))


def _template_bands(templates: DataFrame, known, members: Sequence[int], size: int, bits: int) -> dict[int, list[int]]:
    """The signatures of some templates, by the same expressions as those of the documents."""
    spark = templates.sparkSession
    rows = spark.createDataFrame([(i, known[i][2]) for i in members], "i int, own array<string>")
    keys = F.transform("own", lambda s: _hashes(_word_hashes(F.split(s, " ")), size)[0])
    return {r.i: r.v for r in rows.select("i", _signature(keys, bits).alias("v")).collect()}
