import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from cliptide.llm import divergence

SCHEMA = "lang string, source string, text string, term string, P string, id string"


def plain(rows, min_docs, top):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    groups, files = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text, *_ in rows:
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(lower))
        groups[lang or "", source or ""].update(words)
        files[lang or ""].update(set(words))
    found = set()
    for lang in {k[0] for k in groups}:
        kept = sorted(t for t, n in files[lang].items() if n >= min_docs)
        sources = sorted(s for x, s in groups if x == lang)

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 10**9 * (counts[t] + 5) // (n + 5 * len(kept)) for t in kept}

        own = {s: shares(groups[lang, s]) for s in sources}
        whole = shares(sum((groups[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [(o, sum(abs(own[s][t] - own[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, own[s][t] - whole[t]) for t in kept if groups[lang, s][t] and own[s][t] > whole[t]]
            for part, some in (("pair", pairs), ("term", terms)):
                some.sort(key=lambda x: (-x[1], x[0].encode()))
                found |= {(lang, s, part, item, value, i + 1) for i, (item, value) in enumerate(some) if part == "pair" or i < top}
    return found


def made():
    rng = random.Random(2)
    vocabulary = [f"W{chr(97 + i)}{chr(97 + j)}é" for i in range(8) for j in range(8)] + ["x-y", "a1b", "ß", "ÄÖ"]
    rows = []
    for i in range(300):
        lang = rng.choice(["en", "de", None, "", "xx"])
        source = "hot" if rng.random() < 0.33 else rng.choice([None, "", *map(str, range(12))])
        text = " ".join(rng.choices(vocabulary, k=rng.randrange(0, 60), weights=range(1, len(vocabulary) + 1)))
        rows.append((lang if lang != "xx" or i < 150 else "en", source, text, "a", "b", "c"))
    rows += rows[:20] + [("lonely", "one", "word", "", "", ""), ("lonely", "two", None, "", "", ""), ("en", "mute", "", "", "", ""), ("de", "long", "waaé WABÉ " * 100_000, "", "", "")]
    return rows


@pytest.mark.parametrize(("groups", "terms"), [(32, 8192), (3, 30), (2, 70)])
def test_same_as_plain(spark, groups, terms):
    """Null and empty names and texts, repeated rows, ties, clashing columns, a hot source, small and large cells."""
    rows = made()
    out = divergence.audit(spark.createDataFrame(rows, SCHEMA).repartition(6), min_docs=5, top=9, groups=groups, terms=terms)
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) and set(got) == plain(rows, 5, 9)


def test_cells_are_bounded(spark):
    rows = [("en", f"s{i % 40}", " ".join(f"w{chr(97 + j % 26)}{chr(97 + j // 26)}" for j in range(i % 40, i % 40 + 200)), "", "", "") for i in range(400)]
    made = divergence.Audit(spark.createDataFrame(rows, SCHEMA), min_docs=5, groups=8, terms=20)
    sizes = made.cells().groupBy("lang", "one", "other", "term_block").agg(F.count_distinct("source").alias("s"), F.count_distinct("id").alias("t"))
    worst = sizes.agg(F.max("s"), F.max("t"), F.count(F.lit(1))).first()
    assert worst[0] <= 40 and worst[1] <= 60 and worst[2] > 100


def test_share_is_exact(spark):
    n = 9_000_000_000_000_000
    row = spark.range(1).select(divergence.share(F.lit(n), F.lit(3 * n), F.lit(10**9)).alias("p")).first()
    assert row.p == 1 + 10**9 * (n + 5) // (3 * n + 5 * 10**9)


def test_empty(spark):
    assert divergence.audit(spark.createDataFrame([], SCHEMA)).collect() == []
