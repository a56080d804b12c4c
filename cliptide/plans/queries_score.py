"""Queries for scoring, ensembles, top classes, metrics and distributions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from cliptide.operators import curate, evaluate, score, sequence
from cliptide.plans import bindings as b
from cliptide.plans import jobs
from cliptide.plans.registry import query

PICKED = {"class, 3": "tv_score", "class, 7": "radio_score"}


def _long_scores(spark, sf):
    return score.exploded_scores(b.frame_scores(spark, sf))


def _means(spark, sf):
    return score.class_means(_long_scores(spark, sf), ["clip"])


@query("a8_class_means", f"WITH {b.SCORES} SELECT clip, CAST(class_idx AS INTEGER) AS class_idx, round(score, 6) AS score FROM means")
def _(spark, sf):
    return _means(spark, sf).withColumn("score", F.round("score", 6))


_NAMED = f"""{b.SCORES}, {b.VOC}, named AS (
  SELECT clip, max(CASE WHEN display_name = 'class, 3' THEN score END) AS tv_score,
         max(CASE WHEN display_name = 'class, 7' THEN score END) AS radio_score
  FROM means JOIN voc ON class_idx = "index" GROUP BY clip)"""


@query("j5_named_scores", f"WITH {_NAMED} SELECT clip, round(tv_score, 6) AS tv_score, round(radio_score, 6) AS radio_score FROM named")
def _(spark, sf):
    named = score.named_scores(_long_scores(spark, sf), b.vocabulary(spark, sf), ["clip"], PICKED)
    return named.select("clip", *[F.round(c, 6).alias(c) for c in PICKED.values()])


@query("p18_combined_score", f"WITH {_NAMED} SELECT clip, round(tv_score + radio_score, 6) AS score FROM named")
def _(spark, sf):
    named = score.named_scores(_long_scores(spark, sf), b.vocabulary(spark, sf), ["clip"], PICKED)
    return named.select("clip", F.round(score.combined_score(F.col("tv_score"), F.col("radio_score")), 6).alias("score"))


_TOP = f"""{b.SCORES}, top AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY clip ORDER BY score DESC, class_idx) AS rank FROM means) WHERE rank <= 5)"""


@query(
    "t1_top_classes",
    f"WITH {_TOP} SELECT clip, CAST(class_idx AS INTEGER) AS class_idx, CAST(rank AS INTEGER) AS rank FROM top",
)
def _(spark, sf):
    return score.top_classes(_means(spark, sf), ["clip"], 5).select("clip", "class_idx", "rank")


@query(
    "t2_expected_in_top",
    f"""WITH {_TOP}, expected AS (SELECT DISTINCT clip, CAST(clip * 5 % 64 AS INTEGER) AS class_idx FROM means)
    SELECT e.clip, e.class_idx, CAST(t.clip IS NOT NULL AS INTEGER) AS hit
    FROM expected e LEFT JOIN top t ON e.clip = t.clip AND e.class_idx = t.class_idx""",
)
def _(spark, sf):
    return _checked(spark, sf).select("clip", "class_idx", "hit")


def _checked(spark, sf):
    expected = b.table(spark, sf, "embeddings").select(
        F.col("label").alias("clip"), (F.col("label") * 5 % 64).cast("int").alias("class_idx")
    )
    top = score.top_classes(_means(spark, sf), ["clip"], 5)
    return score.expected_in_top(top, expected.distinct(), ["clip"])


@query(
    "t2_hit_rate",
    f"""WITH {_TOP}, expected AS (SELECT DISTINCT clip, clip * 5 % 64 AS class_idx FROM means)
    SELECT count(*) AS clips, count(t.clip) AS hits, round(count(t.clip) / count(*), 6) AS hit_rate
    FROM expected e LEFT JOIN top t ON e.clip = t.clip AND e.class_idx = t.class_idx""",
)
def _(spark, sf):
    return score.hit_rate(_checked(spark, sf)).withColumn("hit_rate", F.round("hit_rate", 6))


@query(
    "j7_rows_by_model",
    f"""WITH {b.MEM} SELECT clip_id, label, 'm0' AS model, round(m0, 6) AS score FROM mem
    UNION ALL SELECT clip_id, label, 'm1', round(m1, 6) FROM mem UNION ALL SELECT clip_id, label, 'm2', round(m2, 6) FROM mem""",
)
def _(spark, sf):
    return score.by_model(b.members(spark, sf), ["m0", "m1", "m2"]).withColumn("score", F.round("score", 6))


@query(
    "j8_nearest_median",
    f"""WITH {b.MEM}, med AS (SELECT label AS l, median(m0) AS m FROM mem GROUP BY label),
    near AS (SELECT clip_id, l, row_number() OVER (PARTITION BY clip_id ORDER BY abs(m0 - m), l) AS r FROM mem, med)
    SELECT clip_id, l AS nearest FROM near WHERE r = 1""",
)
def _(spark, sf):
    return score.nearest_median(b.members(spark, sf), "label", "m0").select("clip_id", "nearest")


@query(
    "j8_many_labels",
    """WITH med AS (SELECT l_orderkey AS l, median(l_extendedprice) AS m FROM lineitem GROUP BY 1),
    ref AS (SELECT m, min(l) AS l FROM med GROUP BY m),
    near AS (SELECT l_orderkey, l_linenumber, l_extendedprice AS x, lo.l AS ll, lo.m AS lm, hi.l AS hl, hi.m AS hm
      FROM lineitem ASOF LEFT JOIN ref lo ON l_extendedprice >= lo.m ASOF LEFT JOIN ref hi ON l_extendedprice <= hi.m)
    SELECT l_orderkey, l_linenumber, CASE WHEN ll IS NULL THEN hl WHEN hl IS NULL THEN ll WHEN x - lm < hm - x THEN ll
      WHEN x - lm > hm - x THEN hl ELSE least(ll, hl) END AS nearest FROM near""",
)
def _(spark, sf):
    """Every order is a label of its own: each line finds the order whose median price is nearest."""
    lines = b.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    return score.nearest_median(lines, "l_orderkey", "l_extendedprice").drop("l_extendedprice")


@query("a9_median_per_label", f"WITH {b.MEM} SELECT label, round(median(m0), 6) AS median FROM mem GROUP BY label")
def _(spark, sf):
    return evaluate.median_per_label(b.members(spark, sf), "label", "m0").withColumn("median", F.round("median", 6))


@query(
    "a9_median_per_type",
    "SELECT event_type, round(median(value), 6) AS median FROM events GROUP BY event_type",
)
def _(spark, sf):
    events = b.table(spark, sf, "events")
    return evaluate.median_per_label(events, "event_type", "value").withColumn("median", F.round("median", 6))


@query(
    "m4_thresholded_mean",
    f"""WITH {b.MEM} SELECT clip_id, CAST(round_even((CASE WHEN m0 > 0.5 THEN m0 ELSE 0 END + CASE WHEN m1 > 0.5 THEN m1 ELSE 0 END
      + CASE WHEN m2 > 0.5 THEN m2 ELSE 0 END) / 3.0, 0) AS INTEGER) AS vote FROM mem""",
)
def _(spark, sf):
    vote = score.thresholded_mean([F.col(m) for m in ("m0", "m1", "m2")])
    return b.members(spark, sf).select("clip_id", vote.alias("vote"))


@query(
    "m5_posterior_weighted",
    f"""WITH {b.MEM}, l AS (SELECT *, CASE label WHEN 1 THEN m0 ELSE 1 - m0 END AS l0,
      CASE label WHEN 1 THEN m1 ELSE 1 - m1 END AS l1, CASE label WHEN 1 THEN m2 ELSE 1 - m2 END AS l2 FROM mem),
    p AS (SELECT clip_id, (l0 * (1 - m0) + l1 * (1 - m1) + l2 * (1 - m2)) / (l0 + l1 + l2) AS p0,
      (l0 * m0 + l1 * m1 + l2 * m2) / (l0 + l1 + l2) AS p1 FROM l)
    SELECT clip_id, CAST(CASE WHEN p1 > p0 THEN 1 ELSE 0 END AS INTEGER) AS y_pred FROM p""",
)
def _(spark, sf):
    models = [F.array(1 - F.col(m), F.col(m)) for m in ("m0", "m1", "m2")]
    return b.members(spark, sf).select("clip_id", score.posterior_weighted(models, F.col("label")).alias("y_pred"))


# --- metrics -----------------------------------------------------------------------------


def metric_sql(by: str, source: str = "pred") -> str:
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""(SELECT {keys}tn, fp, fn, tp, (tp + tn) / n AS accuracy,
      CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END AS precision,
      CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END AS recall,
      CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END AS f1,
      CASE WHEN tn + fp = 0 THEN 0 ELSE tn / (tn + fp) END AS specificity
      FROM (SELECT {keys}count(*) AS n, count(*) FILTER (y_true = 0 AND y_pred = 0) AS tn,
        count(*) FILTER (y_true = 0 AND y_pred = 1) AS fp, count(*) FILTER (y_true = 1 AND y_pred = 0) AS fn,
        count(*) FILTER (y_true = 1 AND y_pred = 1) AS tp FROM {source} {group}))"""


METRICS = ["accuracy", "precision", "recall", "f1", "specificity"]
ROUNDED = ", ".join(f"round({m}, 6) AS {m}" for m in METRICS)


def rounded(df, columns=METRICS):
    return df.withColumns({c: F.round(c, 6) for c in columns})


@query("a10_binary_metrics", f"WITH {b.PRED} SELECT tn, fp, fn, tp, {ROUNDED} FROM {metric_sql('')}")
def _(spark, sf):
    return rounded(evaluate.binary_metrics(b.predictions(spark, sf)))


@query(
    "a10_negative_class_metrics",
    f"""WITH {b.PRED}, flip AS (SELECT 1 - y_true AS y_true, 1 - y_pred AS y_pred FROM pred)
    SELECT tn, fp, fn, tp, {ROUNDED} FROM {metric_sql('', 'flip')}""",
)
def _(spark, sf):
    return rounded(evaluate.binary_metrics(b.predictions(spark, sf), positive_class=0))


@query("m10_metrics_by_dataset", f"WITH {b.PRED} SELECT dataset, tn, fp, fn, tp, {ROUNDED} FROM {metric_sql('dataset')}")
def _(spark, sf):
    return rounded(evaluate.binary_metrics(b.predictions(spark, sf), ["dataset"]))


@query(
    "a11_confusion",
    f"""WITH {b.PRED} SELECT dataset, y_true, count(*) FILTER (y_pred = 0) AS pred_0, count(*) FILTER (y_pred = 1) AS pred_1
    FROM pred GROUP BY 1, 2""",
)
def _(spark, sf):
    return evaluate.confusion(b.predictions(spark, sf), ["dataset"])


@query(
    "a12_classification_report",
    f"""WITH {b.PRED}, cls AS (SELECT DISTINCT fold, c FROM (SELECT fold, y_true AS c FROM pred UNION ALL SELECT fold, y_pred FROM pred)),
    cnt AS (SELECT k.fold, k.c, count(*) FILTER (y_true = c) AS support, count(*) FILTER (y_pred = c) AS claimed,
      count(*) FILTER (y_true = c AND y_pred = c) AS hit FROM cls k JOIN pred p ON k.fold = p.fold GROUP BY 1, 2),
    per AS (SELECT fold, CAST(c AS VARCHAR) AS "row", support, hit, CASE WHEN claimed = 0 THEN 0 ELSE hit / claimed END AS precision,
      CASE WHEN support = 0 THEN 0 ELSE hit / support END AS recall,
      CASE WHEN claimed + support = 0 THEN 0 ELSE 2 * hit / (claimed + support) END AS f1 FROM cnt),
    tot AS (SELECT fold, sum(hit) / sum(support) AS acc, avg(precision) AS mp, avg(recall) AS mr, avg(f1) AS mf,
      sum(precision * support) / sum(support) AS wp, sum(recall * support) / sum(support) AS wr,
      sum(f1 * support) / sum(support) AS wf, CAST(sum(support) AS BIGINT) AS support FROM per GROUP BY fold)
    SELECT fold, "row", round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM per
    UNION ALL SELECT fold, 'accuracy', round(acc, 6), round(acc, 6), round(acc, 6), support FROM tot
    UNION ALL SELECT fold, 'macro avg', round(mp, 6), round(mr, 6), round(mf, 6), support FROM tot
    UNION ALL SELECT fold, 'weighted avg', round(wp, 6), round(wr, 6), round(wf, 6), support FROM tot""",
)
def _(spark, sf):
    return rounded(evaluate.classification_report(b.predictions(spark, sf), ["fold"]), ["precision", "recall", "f1"])


_FOLD_MEANS = f"""{b.PRED}, each AS {metric_sql('model, fold')},
  fm AS (SELECT model, avg(accuracy) AS accuracy, avg(precision) AS precision, avg(recall) AS recall, avg(f1) AS f1
  FROM each GROUP BY model)"""


@query(
    "a13_mean_over_folds",
    f"""WITH {_FOLD_MEANS} SELECT model, round(accuracy, 6) AS accuracy,
    round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 FROM fm""",
)
def _(spark, sf):
    each = evaluate.binary_metrics(b.predictions(spark, sf), ["model", "fold"])
    return rounded(evaluate.mean_over_folds(each, ["model"]), ["accuracy", "precision", "recall", "f1"])


@query(
    "m11_model_comparison",
    f"""WITH {_FOLD_MEANS}, long AS (
      SELECT model, 'accuracy' AS metric, accuracy AS v FROM fm UNION ALL SELECT model, 'precision', precision FROM fm
      UNION ALL SELECT model, 'recall', recall FROM fm UNION ALL SELECT model, 'f1', f1 FROM fm)
    SELECT metric, round(max(v) FILTER (model = 'm0'), 6) AS m0, round(max(v) FILTER (model = 'm1'), 6) AS m1,
      round(max(v) FILTER (model = 'm2'), 6) AS m2 FROM long GROUP BY metric""",
)
def _(spark, sf):
    models = ["m0", "m1", "m2"]
    table = jobs.fold_comparison(b.predictions(spark, sf).select("model", "fold", "y_true", "y_pred"), models)
    return rounded(table, models)


# --- distributions -----------------------------------------------------------------------


def _histogram_sql(source: str, bins: int) -> str:
    return f"""WITH {source}, ext AS (SELECT subset, min(score) AS a, max(score) AS z FROM src GROUP BY subset),
    lim AS (SELECT subset, CASE WHEN a = z THEN a - 0.5 ELSE a END AS lo, CASE WHEN a = z THEN z + 0.5 ELSE z END AS hi FROM ext),
    g AS (SELECT s.subset, score, lo, (hi - lo) / {bins} AS step,
      least(CAST(floor((score - lo) / ((hi - lo) / {bins})) AS BIGINT), {bins - 1}) AS k FROM src s JOIN lim l ON s.subset = l.subset),
    f AS (SELECT subset, lo, step, CASE WHEN score < lo + k * step THEN k - 1
      WHEN score >= lo + (k + 1) * step AND k < {bins - 1} THEN k + 1 ELSE k END AS bin FROM g)
    SELECT subset, CAST(bin AS BIGINT) AS bin, round(lo + bin * step, 6) AS "left", round(lo + (bin + 1) * step, 6) AS "right",
      count(*) AS n FROM f GROUP BY subset, lo, step, bin"""


@query("a14_histogram", _histogram_sql("src AS (SELECT event_type AS subset, value AS score FROM events)", 50))
def _(spark, sf):
    events = b.table(spark, sf, "events").select(F.col("event_type").alias("subset"), F.col("value").alias("score"))
    return rounded(evaluate.histogram(events, "subset", "score", 50), ["left", "right"])


FLAGGED = """src AS (SELECT 'Talk' AS subset, l_extendedprice AS score FROM lineitem WHERE l_returnflag = 'R'
  UNION ALL SELECT 'Alone', l_extendedprice FROM lineitem WHERE l_linestatus = 'O'
  UNION ALL SELECT 'Phone', l_extendedprice FROM lineitem WHERE l_discount >= 0.05)"""


@query("a14_histogram_of_flags", _histogram_sql(FLAGGED, 10))
def _(spark, sf):
    wide = b.table(spark, sf, "lineitem").select(
        F.col("l_extendedprice").alias("score"),
        (F.col("l_returnflag") == "R").cast("int").alias("Talk"),
        (F.col("l_linestatus") == "O").cast("int").alias("Alone"),
        (F.col("l_discount") >= 0.05).cast("int").alias("Phone"),
    )
    long = curate.subset_scores(wide, "score", ["Talk", "Alone", "Phone", "Gossip"])
    return rounded(evaluate.histogram(long, "subset", "score", 10), ["left", "right"])


@query(
    "a15_density",
    """WITH m AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
      FROM events GROUP BY 1),
    grid AS (SELECT *, p.p AS point, lo - 3 * h + (hi - lo + 6 * h) / 49 * p.p AS x FROM m, range(50) p(p))
    SELECT g.event_type, CAST(g.point AS INTEGER) AS point, round(g.x, 6) AS x,
      round(sum(exp(-pow((e.value - g.x) / g.h, 2) / 2)) / (any_value(g.n) * any_value(g.h) * sqrt(2 * pi())), 6) AS density
    FROM grid g JOIN events e ON g.event_type = e.event_type GROUP BY 1, 2, 3""",
)
def _(spark, sf):
    return rounded(evaluate.density(b.table(spark, sf, "events"), "event_type", "value"), ["x", "density"])


@query(
    "a15_binned_density",
    """WITH m AS (SELECT event_type, count(*) AS n, stddev_samp(value) * pow(count(*), -0.2) AS h, min(value) AS lo, max(value) AS hi
      FROM events GROUP BY 1),
    g AS (SELECT event_type, n, h, lo - 3 * h AS base, hi - lo + 6 * h AS span FROM m WHERE h > 0),
    placed AS (SELECT event_type, (value - base) / span * 2000 AS pos FROM events JOIN g USING (event_type) WHERE value IS NOT NULL),
    cell AS (SELECT event_type, CAST(least(floor(pos), 1999) AS INTEGER) AS c, pos FROM placed),
    side AS (SELECT event_type, c, sum(1 - (pos - c)) AS w FROM cell GROUP BY 1, 2
      UNION ALL SELECT event_type, c + 1, sum(pos - c) FROM cell GROUP BY 1, 2)
    SELECT event_type, CAST(p.p AS INTEGER) AS point, round(any_value(base + span / 49 * p.p), 6) AS x,
      round(sum(w * exp(-pow((c / 2000.0 - p.p / 49.0) * span / h, 2) / 2)) / any_value(n * h * sqrt(2 * pi())), 6) AS density
    FROM side JOIN g USING (event_type), range(50) p(p) GROUP BY 1, 2""",
)
def _(spark, sf):
    return rounded(evaluate.binned_density(b.table(spark, sf, "events"), "event_type", "value"), ["x", "density"])


# --- batch model jobs with small stand-in models -------------------------------------------


def no_weights():
    return None


def framewise_mean_and_max(_, batch):
    return [[[f.mean(), f.max()] for f in np.asarray(wave, np.float64).reshape(4, 16)] for wave in batch]


def framewise_logistic(_, batch):
    return [1 / (1 + np.exp(-np.asarray(wave, np.float64).reshape(4, 16))) for wave in batch]


@query(
    "m1_batch_embedding",
    """WITH cells AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)
    SELECT vec_id, CAST(i // 16 AS INTEGER) AS frame, round(avg(v), 4) AS mean, round(max(v), 4) AS top
    FROM cells GROUP BY 1, 2""",
)
def _(spark, sf):
    chunks = b.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("samples"))
    embedded = score.embed(chunks, no_weights, framewise_mean_and_max)
    at = lambda i: F.round(F.get("embedding", F.lit(i)).cast("double"), 4)
    return embedded.select("vec_id", "frame", at(0).alias("mean"), at(1).alias("top"))


@query(
    "m2_clip_scores",
    """WITH cells AS (SELECT e.vec_id, l.quality AS tv, i.i, 1 / (1 + exp(-CAST(embedding[i.i + 1] AS DOUBLE))) AS s
      FROM embeddings e JOIN labels l ON e.vec_id = l.doc_id, range(64) i(i))
    SELECT vec_id AS filename, tv, round(avg(s) FILTER (i % 16 = 3), 4) AS tv_score, round(avg(s) FILTER (i % 16 = 7), 4) AS radio_score
    FROM cells GROUP BY 1, 2""",
)
def _(spark, sf):
    clips = b.table(spark, sf, "embeddings").select(F.col("vec_id").alias("filename"), F.col("embedding").alias("samples"))
    truth = b.table(spark, sf, "labels").select(F.col("doc_id").alias("filename"), F.col("quality").alias("tv"))
    clips = curate.labelled(clips, truth, "filename")
    scored = jobs.clip_scores(clips, b.vocabulary(spark, sf), no_weights, framewise_logistic, PICKED)
    return scored.select("filename", "tv", *[F.round(c, 4).alias(c) for c in PICKED.values()])


def weighted_mean_model():
    weights = (np.arange(64) % 7 - 3) / 10

    def predict(batch):
        return 1 / (1 + np.exp(-(batch.astype(np.float64).reshape(len(batch), 31, 64) @ weights).mean(axis=1)))

    return predict


@query(
    "m3_sequence_scores",
    f"""WITH {b.seq_sql(40)}, cells AS (
      SELECT seq_id, pos, generate_subscripts(embedding, 1) - 1 AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM seq)
    SELECT seq_id, round(1 / (1 + exp(-sum(v * (i % 7 - 3) / 10.0) FILTER (pos < 31) / 31)), 6) AS score FROM cells GROUP BY 1""",
)
def _(spark, sf):
    whole = sequence.sequences(b.numbered(spark, sf, 40), "seq_id", length=31)
    padded = sequence.pad_sequences(whole, 64, 31)
    scored = score.score_sequences(padded, weighted_mean_model, [31 * 64])
    return scored.select("seq_id", F.round("score", 6).alias("score"))
