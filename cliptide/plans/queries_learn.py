"""Queries that fit models on the embeddings."""

from __future__ import annotations

from pyspark.sql import functions as F

from cliptide.operators import codebook, learn, neighbourhoods, sample, sequence
from cliptide.plans import bindings as b
from cliptide.plans.registry import query


def _labelled(spark, sf):
    rows = b.table(spark, sf, "embeddings").select("vec_id", (F.col("label") % 2).cast("double").alias("label"), "embedding")
    return sample.shuffled_folds(learn.as_vector(rows, "embedding"), "vec_id")


@query("m6_fold_metrics")
def _(spark, sf):
    return learn.fold_metrics(_labelled(spark, sf), 4)


@query("m6_radial_folds")
def _(spark, sf):
    """Radial kernel by landmarks, fitted on each fold's training rows; gamma is 1 / width."""
    return learn.fold_metrics(_labelled(spark, sf), 4, learn.linear_classifier(scaled=False), prepare=learn.radial_preparation("embedding", "vec_id"))


@query(
    "m6_fold_counts",
    """WITH ranked AS (SELECT label % 2 AS label, row_number() OVER (ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS r FROM embeddings)
    SELECT CAST(r % 4 AS INTEGER) AS fold, count(*) AS n, CAST(sum(label) AS BIGINT) AS positive FROM ranked GROUP BY 1""",
)
def _(spark, sf):
    """Every row is predicted once, in the fold that the seeded hash order gives it."""
    out = learn.fold_predictions(_labelled(spark, sf), 4, keep=["vec_id"])
    return out.groupBy(F.col("fold").cast("int").alias("fold")).agg(F.count_distinct("vec_id").alias("n"), F.sum("y_true").alias("positive"))


def _sequences(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf, 10), "seq_id", keep=["label"])
    padded = sequence.pad_sequences(whole, 64, 10).withColumn("label", (F.col("label") % 2).cast("double"))
    return sample.shuffled_folds(learn.pooled(padded).select("seq_id", "label", "features"), "seq_id")


@query("m7_pooled_classifier")
def _(spark, sf):
    return learn.fold_predictions(_sequences(spark, sf), 4, learn.pooled_classifier(), keep=["seq_id"])


@query("m7_residual_classifier")
def _(spark, sf):
    """Sequences pooled against a codebook that is learned in each fold's training rows."""
    whole = sequence.sequences(b.numbered(spark, sf, 10), "seq_id", keep=["label"]).withColumn("label", (F.col("label") % 2).cast("double"))
    prepare = codebook.residual_preparation("seq_id", words=8, parts=2)
    return learn.fold_predictions(sample.shuffled_folds(whole, "seq_id"), 4, learn.pooled_classifier(), keep=["seq_id"], prepare=prepare)


def _nearest_sql(words: str, name: str) -> str:
    """Each value's word: least squared distance, ties to the smaller word."""
    return f"""{name} AS (
  SELECT vec_id, arg_min(word, (d, word)) AS word FROM (
    SELECT vec_id, word, sum((value - centre) * (value - centre)) AS d FROM value JOIN {words} USING (place) GROUP BY 1, 2) GROUP BY 1)"""


@query(
    "m7_residual_pooling",
    f"""WITH {b.seq_sql(10)}, value AS (
  SELECT vec_id, seq_id, unnest(range(len(embedding))) AS place, CAST(unnest(embedding) AS DOUBLE) AS value FROM seq
), first AS (
  SELECT vec_id, row_number() OVER (ORDER BY md5(concat('42:', CAST(vec_id AS VARCHAR))), vec_id) - 1 AS word FROM embeddings QUALIFY word < 8
), began AS (
  SELECT word, place, value AS centre FROM value JOIN first USING (vec_id)
), {_nearest_sql("began", "near")}, moved AS (
  SELECT word, place, avg(value) AS centre FROM value JOIN near USING (vec_id) GROUP BY 1, 2
), book AS (
  SELECT word, place, coalesce(moved.centre, began.centre) AS centre FROM began LEFT JOIN moved USING (word, place)
), {_nearest_sql("book", "settled")}, pooled AS (
  SELECT seq_id, word, place, sum(value - centre) AS s FROM value JOIN settled USING (vec_id) JOIN book USING (word, place) GROUP BY 1, 2, 3
), sized AS (
  SELECT seq_id, count(*) AS n FROM seq GROUP BY 1
)
SELECT seq_id, CAST(word AS INTEGER) AS word, CAST(place AS INTEGER) AS place, round(coalesce(s, 0) / n, 6) + 0.0 AS value
FROM sized CROSS JOIN book LEFT JOIN pooled USING (seq_id, word, place)""",
)
def _(spark, sf):
    """The pooled values of every sequence, against eight words after one round."""
    rows = b.numbered(spark, sf, 10)
    book = codebook.learn_codebook(rows, "embedding", "vec_id", words=8, rounds=1)
    pooled = sequence.sequences(rows, "seq_id").select("seq_id", book.column(F.col("frames")).alias("v"))
    at = pooled.select("seq_id", F.posexplode("v").alias("at", "value"))
    return at.select(
        "seq_id", F.floor(F.col("at") / book.width).cast("int").alias("word"), (F.col("at") % book.width).alias("place"),
        (F.round("value", 6) + 0.0).alias("value"),
    )


@query("m8_parameter_search")
def _(spark, sf):
    return learn.search_table(spark, learn.search(_labelled(spark, sf)))


@query("m9_projection")
def _(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf), "seq_id", keep=["label"])
    return learn.projection(sequence.label_frames(whole), "embedding", 2, ["seq_id", "frame", "label"])


@query("m9_neighbour_map")
def _(spark, sf):
    """Coordinates of all vectors by their neighbourhoods."""
    rows = b.table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return rows.select("vec_id", "label").join(neighbourhoods.neighbour_map(rows, "vec_id", "embedding"), "vec_id")
