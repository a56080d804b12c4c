import numpy as np
import pytest
from pyspark.sql import functions as F

from cliptide.llm import toxicity
from cliptide.llm.common import held_out

SF = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{SF}/labels.parquet")


@pytest.fixture(scope="module")
def model(tables):
    return toxicity.train(*tables, max_rows=3000)


def test_held_out_quality(tables, model):
    docs, labels = tables
    rows = toxicity.score(docs, model).join(labels, "doc_id").filter(held_out(F.col("doc_id"))).select("toxic", "toxicity.score", "toxicity.predicted").collect()
    toxic, score, predicted = (np.array([r[i] for r in rows]) for i in range(3))
    order = np.argsort(score)
    ranks = np.empty(len(score))
    ranks[order] = np.arange(len(score))
    auc = (ranks[toxic == 1].mean() - (toxic.sum() - 1) / 2) / (toxic == 0).sum()
    assert auc > 0.9
    assert toxic[predicted == 1].mean() > 0.8
    assert (score >= 0).all() and (score <= 1).all()


def test_edges(spark, model):
    word = max((w for w in model.lexicon if "*" not in w), key=model.lexicon.get)
    rows = [(1, None), (2, ""), (3, f"you {word} " * 30), (4, "plain words " * 50_000), (4, "plain words " * 50_000), (5, "!!! $$$ 123")]
    df = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, toxicity string, features string")
    found = toxicity.score(df, model)
    assert found.columns == ["doc_id", "text", "toxicity", "features", "toxicity_"]
    got = {r.doc_id: r.toxicity_ for r in found.collect()}
    assert got[3].predicted == 1 and got[4].predicted == 0 and got[1].score == got[2].score
    assert all(r.predicted == (r.score >= 0.3) for r in got.values())
    assert toxicity.score(df.limit(0), model).count() == 0


def test_too_little_to_learn(spark):
    docs = spark.createDataFrame([(i, "text") for i in range(8)], "doc_id long, text string")
    kinds = "doc_id long, toxic int"
    assert toxicity.score(docs, toxicity.train(docs, spark.createDataFrame([], kinds))).select("toxicity.score").distinct().collect()[0][0] == 0
    one = toxicity.train(docs, spark.createDataFrame([(i, 1) for i in range(8)] + [(None, 0), (3, None)], kinds))
    assert one.trees is None and one.share == 1


def test_longest_entry_counts():
    lexicon = toxicity.Lexicon({"abcd*": 1.0, "abcdef*": 2.0, "abcdefgh": 3.0})
    assert [lexicon.find(w) for w in ("abcd", "abcde", "abcdefg", "abcdefgh", "abc", "xabcde")] == [None, "abcd*", "abcdef*", "abcdefgh", None, None]


def test_features():
    value = "You WORTHLESS id1ot!!! aaa".encode()
    got = dict(zip(toxicity.FEATURES, toxicity.features(value, toxicity.Lexicon({"worth*": 5.0, "idiot": 4.0}))))
    assert got["log_hits"] == pytest.approx(np.log(2)) and got["near_second_person"] == 1 and got["disguised_hits"] == 1
    assert got["top_weight"] == 5 and got["shouted"] > 0 and got["exclamations"] > 0 and got["repeats"] > 0
    assert not any(toxicity.features(b"", toxicity.Lexicon({"a": 1.0})))
