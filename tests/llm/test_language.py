import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.llm import language
from cliptide.llm.common import held_out

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def model(docs):
    return language.train(docs)


def test_held_out_accuracy(docs, model):
    rows = language.identify(docs, model).filter(held_out(F.col("doc_id"))).select("lang", "language.*").collect()
    assert np.mean([r.lang == r.lang_pred for r in rows]) > 0.97
    assert all(0 <= r.score <= 1 and abs(sum(r.shares) - 1) < 1e-6 for r in rows)


def test_mixed_texts_show_both_languages(spark, docs, model):
    by = {r.lang: r.text for r in docs.filter(F.length("text") > 3000).groupBy("lang").agg(F.max_by("text", "doc_id").alias("text")).collect()}
    rows = [("de", "fr", by["de"][:1400] + " " + by["fr"][:700]), ("es", "en", by["es"][:2000] + " " + by["en"][:900])]
    found = language.identify(spark.createDataFrame(rows, "a string, b string, text string"), model).collect()
    for r in found:
        assert r.language.lang_pred == r.a and set(r.language.langs) == {r.a, r.b}
        assert 0.5 < r.language.score < 0.85


def test_edges(spark, model):
    rows = [(1, None), (2, ""), (3, "12 %$ !!\n"), (4, "é"), (5, "The and the of " * 100_000), (6, "\U0001d7d8 ٣"), (7, "a"), (7, "a")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, language string")
    found = {r.doc_id: r.language_ for r in language.identify(df, model).collect()}
    assert {i: r.lang_pred == "und" for i, r in found.items()} == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False}
    assert all(found[i].score == 0 and found[i].langs == [] for i in (1, 2, 3, 6))
    assert found[5].lang_pred == "en"
    assert language.identify(df.limit(0), model).count() == 0


def test_nothing_learned(spark, docs):
    model = language.train(docs.limit(0))
    assert model.names == []
    df = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    assert language.identify(df, model).first().language.lang_pred == "und"


def test_most_frequent_languages_are_learned(spark):
    rows = [(i, "one", "a") for i in range(20)] + [(i, "two", "b") for i in range(40, 50)] + [(99, "x", None), (None, "three", "c")]
    model = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), max_languages=2)
    assert model.names == ["a", "b"]


def test_held_out_rows_are_not_learned_from(spark):
    import zlib

    out = [i for i in range(200) if zlib.crc32(str(i).encode()) % 4 == 2]
    rows = [(i, "zzz", "out") for i in out] + [(i, "abc", "in") for i in range(200) if i not in out]
    assert language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string")).names == ["in"]


def test_expectation_maximisation_finds_known_shares():
    rng = np.random.default_rng(1)
    p = rng.dirichlet(np.full(300, 0.3), 2)
    drawn = np.concatenate([rng.choice(300, 700, p=p[0]), rng.choice(300, 300, p=p[1])])
    share, _ = language.mixture(p[:, drawn], 50)
    assert abs(share[0] - 0.7) < 0.05
    many = language.mixtures(p[:, np.tile(drawn, 2)].astype(np.float32), np.array([0, 1000, 1000, 2000]), 50)
    assert np.allclose(many[:, 0], share, atol=0.01) and many[:, 1].tolist() == [0, 0] and np.allclose(many[:, 2], many[:, 0])


def test_texts_are_kept_apart():
    rng = random.Random(1)
    texts = ["".join(rng.choice("ab c1É") for _ in range(rng.randint(0, 20))).encode() for _ in range(50)] + [None]
    together, bounds = language.grams(texts)
    for text, a, b in zip(texts, bounds[:-1], bounds[1:]):
        assert together[a:b].tolist() == language.grams([text])[0].tolist()


def test_every_language_is_learned(spark):
    """300 languages, each with words of its own: all are learned and told apart."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyzßéèàùñøåöüçğışžčřłóąęαβγδεζηθικλμνξοπρστυφχψω"
    words = {f"l{i:03}": ["".join(rng.choices(letters, k=6)) for _ in range(12)] for i in range(300)}
    rows = [(i, " ".join(rng.choices(words[name], k=40)), name) for i, name in enumerate(sorted(words) * 4)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.train(df)
    assert model.names == sorted(words)
    found = language.identify(df, model).filter(held_out(F.col("doc_id"))).collect()
    assert len(found) > 200 and np.mean([r.lang == r.language.lang_pred for r in found]) > 0.99


def test_numerals_are_no_letters(spark, model):
    rows = [("½",), ("² ³",), ("①",), ("Ⅷ 12",), ("٣",), ("ª",), ("a½",), ("日本",), ("ⅷ",)]
    found = language.identify(spark.createDataFrame(rows, "text string"), model).collect()
    assert {r.text: r.language.lang_pred != "und" for r in found} == {t: any(c.isalpha() for c in t) for t, in rows}


def plain_grams(text):
    """Trigrams of letters by plain string work, as byte triples."""
    body = text.lower().encode()
    body = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in body)
    body = b"  " + body + b"  "
    return [body[i : i + 3] for i in range(len(body) - 2) if b"  " not in (body[i : i + 2], body[i + 1 : i + 3])]


def test_mixture_same_as_plain(spark):
    """Plain EM with every subset of languages: the chosen set, its shares and the score."""
    import itertools
    import math

    teach = [(0, "the cat sat on the mat and the dog", "en"), (1, "der hund und die katze auf der matte", "de"), (3, "el perro y el gato en la casa", "es")]
    df = spark.createDataFrame([(10 * i + d, t, lang) for i in range(6) for d, t, lang in teach], "doc_id long, text string, lang string")
    usable = [r for r in df.withColumn("out", held_out(F.col("doc_id"))).collect() if not r.out]
    model = language.train(df)
    bucket = lambda g: (int.from_bytes(g, "big") * 2654435761 % 2**32) >> 16
    counts = {lang: {} for lang in model.names}
    for r in usable:
        for g in plain_grams(r.text):
            counts[r.lang][bucket(g)] = counts[r.lang].get(bucket(g), 0) + 1
    p = lambda lang, g: (counts[lang].get(bucket(g), 0) + 0.5) / (sum(counts[lang].values()) + 0.5 * 65536)

    def em(langs, found):
        share = [1 / len(langs)] * len(langs)
        for _ in range(500):
            new = [0.0] * len(langs)
            for g in found:
                drawn = [s * p(lang, g) for s, lang in zip(share, langs)]
                new = [n + d / sum(drawn) for n, d in zip(new, drawn)]
            share = [n / len(found) for n in new]
        return share, sum(math.log(sum(s * p(lang, g) for s, lang in zip(share, langs))) for g in found)

    texts = ["the dog sat on the mat", "der hund und die katze", "the cat and the dog sat on the mat der hund und die katze auf der matte", "el perro y la casa"]
    made = {r.text: r.language for r in language.identify(spark.createDataFrame([(t,) for t in texts], "text string"), model, more_steps=500).collect()}
    for text in texts:
        found = plain_grams(text)
        cost = 4.0 * math.log(len(found) + 1)
        best = max(((em(c, found)[1] - cost * (k - 1), c) for k in (1, 2, 3) for c in itertools.combinations(model.names, k)), key=lambda x: x[0])[1]
        assert set(made[text].langs) == set(best)
        share = dict(zip(best, em(best, found)[0]))
        assert all(abs(share[lang] - s) < 0.01 for lang, s in zip(made[text].langs, made[text].shares))
        assert made[text].lang_pred == max(share, key=share.get)
