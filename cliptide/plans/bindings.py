"""How the driver tables stand in for annotations, signals, sequences and scores.

Each binding exists twice: as a DataFrame and as the equivalent SQL common table expression.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cliptide.operators import curate
from cliptide.operators.exact import bucketed_rank, settled
from cliptide.plans import jobs

ORDER = ["coder", "ord1", "ord2"]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def annotations(spark: SparkSession, sf: str) -> DataFrame:
    items = table(spark, sf, "lineitem")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey")
    flag = F.when(F.col("l_returnflag") == "R", "1").when(F.col("l_returnflag") == "A", "0").otherwise(" ")
    return items.join(orders, "l_orderkey").select(
        F.concat(F.lit("clip_"), F.col("l_orderkey").cast("string")).alias("FileName"),
        F.col("o_custkey").alias("Id"),
        F.col("l_linenumber").alias("coder"),
        flag.alias("Tv"),
        F.when(F.col("l_discount") >= 0.09, "1").otherwise("").alias("Problems"),
        F.col("l_partkey").alias("ord1"),
        F.col("l_suppkey").alias("ord2"),
    )


ANN = """ann AS (
  SELECT concat('clip_', CAST(l_orderkey AS VARCHAR)) AS filename, o_custkey AS participant_id, l_linenumber AS coder,
         CASE l_returnflag WHEN 'R' THEN '1' WHEN 'A' THEN '0' ELSE ' ' END AS tv_text,
         CASE WHEN l_discount >= 0.09 THEN '1' ELSE '' END AS problems_text, l_partkey AS ord1, l_suppkey AS ord2
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey),
clean AS (
  SELECT filename, participant_id, coder, ord1, ord2,
         CAST(coalesce(nullif(trim(tv_text), ''), '0') AS INTEGER) AS tv,
         CAST(coalesce(nullif(trim(problems_text), ''), '0') AS INTEGER) AS problems
  FROM ann)"""


def clean(spark: SparkSession, sf: str) -> DataFrame:
    lowered = curate.lower_columns(annotations(spark, sf))
    return curate.clean_flags(curate.rename(lowered, {"id": "participant_id"}), ["tv", "problems"])


def curated(spark: SparkSession, sf: str) -> DataFrame:
    return jobs.curated(annotations(spark, sf), ORDER)


def settled_curated(spark: SparkSession, sf: str) -> DataFrame:
    """The curated clips written once, for operators that read them several times."""
    return settled(curated(spark, sf), "curated")


CUR = ANN + """,
agreed AS (
  SELECT * FROM clean
  WHERE filename IN (SELECT filename FROM clean GROUP BY filename HAVING count(DISTINCT tv) = 1)),
firsts AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filename ORDER BY coder, ord1, ord2) AS rn FROM agreed)
  WHERE rn = 1),
cur AS (SELECT filename, participant_id, tv FROM firsts WHERE problems = 0)"""


def activities(spark: SparkSession, sf: str) -> DataFrame:
    priority = F.col("o_orderpriority")
    activity = (
        F.when(priority == "1-URGENT", "watching tv")
        .when(priority == "2-HIGH", "absence")
        .when(priority == "3-MEDIUM", "working")
        .when(priority == "4-NOT SPECIFIED", "unknown")
        .when(F.col("o_orderstatus") == "F", "cooking")
        .otherwise("other")
    )
    name = F.concat(F.lit("node_"), F.col("o_orderkey").cast("string"))
    return table(spark, sf, "orders").select(name.alias("audio_file"), activity.alias("activity"))


ACT = """act AS (
  SELECT concat('node_', CAST(o_orderkey AS VARCHAR)) AS audio_file,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'watching tv' WHEN '2-HIGH' THEN 'absence'
              WHEN '3-MEDIUM' THEN 'working' WHEN '4-NOT SPECIFIED' THEN 'unknown'
              ELSE CASE WHEN o_orderstatus = 'F' THEN 'cooking' ELSE 'other' END END AS activity
  FROM orders)"""


def binary_activities(spark: SparkSession, sf: str) -> DataFrame:
    kept = curate.drop_activities(activities(spark, sf), ["unknown", "dont use", "other"])
    return curate.rename(curate.binary_activity(kept), {"audio_file": "filename"})


BINACT = ACT + """,
bin AS (
  SELECT audio_file AS filename, activity, CASE WHEN activity = 'watching tv' THEN 1 ELSE 0 END AS tv
  FROM act WHERE activity IS NULL OR activity NOT IN ('unknown', 'dont use', 'other'))"""


def signal(spark: SparkSession, sf: str) -> DataFrame:
    """Long (clip_id, pos, sample) rows; ranked per day first, so one busy user is many tasks."""
    events = table(spark, sf, "events").select("user_id", "ts", "event_id", "value")
    ranked = bucketed_rank(events, "user_id", F.to_date("ts"), ["ts", "event_id"], "_rank")
    return ranked.select(
        F.col("user_id").alias("clip_id"), (F.col("_rank") - 1).alias("pos"), F.col("value").alias("sample")
    )


SIG = """sig AS (
  SELECT user_id AS clip_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS pos, value AS sample
  FROM events)"""


def numbered(spark: SparkSession, sf: str, size: int = 62) -> DataFrame:
    """Embedding rows as frames of sequences."""
    return table(spark, sf, "embeddings").select(
        "vec_id",
        F.floor(F.col("vec_id") / size).alias("seq_id"),
        (F.col("vec_id") % size).alias("pos"),
        "label",
        "embedding",
    )


def seq_sql(size: int = 62) -> str:
    return f"""seq AS (
  SELECT vec_id, CAST(floor(vec_id / {size}) AS BIGINT) AS seq_id, vec_id % {size} AS pos, label, embedding
  FROM embeddings)"""


SEQ = seq_sql()
CELLS = SEQ + """,
cells AS (SELECT seq_id, pos, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM seq)"""


def waves(spark: SparkSession, sf: str) -> DataFrame:
    """Waveform arrays of 1 to 64 samples."""
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        "label",
        F.slice(F.transform("embedding", lambda x: x.cast("double")), F.lit(1), (F.col("vec_id") % 64 + 1).cast("int")).alias("samples"),
    )


WAVES = """waves AS (
  SELECT vec_id AS clip_id, label, CAST(embedding[1:(vec_id % 64 + 1)] AS DOUBLE[]) AS samples FROM embeddings)"""


def logistic(x):
    return 1 / (1 + F.exp(-x))


def frame_scores(spark: SparkSession, sf: str) -> DataFrame:
    """(clip, frame, scores): ten clips with many frames of 64 classes."""
    return table(spark, sf, "embeddings").select(
        F.col("label").alias("clip"),
        F.col("vec_id").alias("frame"),
        F.transform("embedding", lambda x: logistic(x.cast("double"))).alias("scores"),
    )


SCORES = """raw AS (
  SELECT label AS clip, vec_id AS frame, generate_subscripts(embedding, 1) - 1 AS class_idx,
         CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
scores AS (SELECT clip, frame, class_idx, 1 / (1 + exp(-x)) AS score FROM raw),
means AS (SELECT clip, class_idx, avg(score) AS score FROM scores GROUP BY clip, class_idx)"""


def vocabulary(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "part").select(
        (F.col("p_partkey") - 1).cast("int").alias("index"),
        F.col("p_brand").alias("mid"),
        F.concat(F.lit("class, "), (F.col("p_partkey") - 1).cast("string")).alias("display_name"),
    )


VOC = """voc AS (
  SELECT CAST(p_partkey - 1 AS INTEGER) AS "index", p_brand AS mid,
         concat('class, ', CAST(p_partkey - 1 AS VARCHAR)) AS display_name FROM part)"""


def members(spark: SparkSession, sf: str) -> DataFrame:
    """Score of three models per clip, with a binary truth."""
    score = lambda i: logistic(F.get("embedding", F.lit(i)).cast("double") * 4)
    return table(spark, sf, "embeddings").select(
        F.col("vec_id").alias("clip_id"),
        (F.col("label") % 2).alias("label"),
        score(0).alias("m0"), score(1).alias("m1"), score(2).alias("m2"),
    )


MEM = """mem AS (
  SELECT vec_id AS clip_id, label % 2 AS label, 1 / (1 + exp(-4 * CAST(embedding[1] AS DOUBLE))) AS m0,
         1 / (1 + exp(-4 * CAST(embedding[2] AS DOUBLE))) AS m1, 1 / (1 + exp(-4 * CAST(embedding[3] AS DOUBLE))) AS m2
  FROM embeddings)"""


def predictions(spark: SparkSession, sf: str) -> DataFrame:
    documents = table(spark, sf, "documents").select("doc_id", "source")
    return table(spark, sf, "labels").join(documents, "doc_id").select(
        "doc_id",
        F.col("source").alias("dataset"),
        (F.col("doc_id") % 4).alias("fold"),
        F.concat(F.lit("m"), (F.col("doc_id") % 3).cast("string")).alias("model"),
        F.col("quality").alias("y_true"),
        F.col("toxic").alias("y_pred"),
    )


PRED = """pred AS (
  SELECT l.doc_id, d.source AS dataset, l.doc_id % 4 AS fold, concat('m', CAST(l.doc_id % 3 AS VARCHAR)) AS model,
         quality AS y_true, toxic AS y_pred FROM labels l JOIN documents d ON l.doc_id = d.doc_id)"""


def recordings(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        "doc_id",
        F.col("lang").alias("microphone"),
        F.col("source").alias("speaker"),
        (F.col("doc_id") % 2).alias("class_label"),
        (F.col("doc_id") % 3 + 1).cast("string").alias("category"),
        F.col("n_chars").cast("double").alias("duration"),
    )


REC = """rec AS (
  SELECT doc_id, lang AS microphone, source AS speaker, doc_id % 2 AS class_label,
         CAST(doc_id % 3 + 1 AS VARCHAR) AS category, CAST(n_chars AS DOUBLE) AS duration FROM documents)"""
