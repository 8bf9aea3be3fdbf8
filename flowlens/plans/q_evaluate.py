"""Evaluation queries (A19-A31, W2) on lineitem.

truth = l_returnflag (A, N, R); prediction = a rule on l_quantity (< 17 A, < 34 N, else R);
one-vs-rest scores: A = l_quantity / 50, N = 1 - 10 l_discount, R = 12.5 l_tax (all in [0, 1],
many ties).
"""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import evaluate as E
from flowlens.plans import standins as S
from flowlens.plans.registry import register

CLASSES = {"A": "score_a", "N": "score_n", "R": "score_r"}


def scored(spark, sf):
    li = S.lineitem(spark, sf)
    q = F.col("l_quantity")
    return li.select(
        F.col("l_returnflag").alias("truth"),
        F.when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("pred"),
        (q / 50.0).alias("score_a"), (1 - F.col("l_discount") * 10).alias("score_n"),
        (F.col("l_tax") * 12.5).alias("score_r"))


_CM = """
WITH s AS (SELECT l_returnflag AS t,
             CASE WHEN l_quantity < 17 THEN 'A' WHEN l_quantity < 34 THEN 'N' ELSE 'R' END AS p
           FROM lineitem),
cnt AS (SELECT t AS true_class, p AS pred_class, count(*) AS n FROM s GROUP BY ALL),
cls AS (SELECT true_class AS c FROM cnt UNION SELECT pred_class FROM cnt),
cm AS (SELECT a.c AS true_class, b.c AS pred_class, CAST(coalesce(cnt.n, 0) AS BIGINT) AS n
       FROM cls a CROSS JOIN cls b
       LEFT JOIN cnt ON cnt.true_class = a.c AND cnt.pred_class = b.c),
pc0 AS (SELECT cls.c AS class,
          CAST(sum(CASE WHEN cm.true_class = cls.c AND cm.pred_class = cls.c THEN n ELSE 0 END) AS BIGINT) AS tp,
          CAST(sum(CASE WHEN cm.true_class = cls.c THEN n ELSE 0 END) AS BIGINT) AS support,
          CAST(sum(CASE WHEN cm.pred_class = cls.c THEN n ELSE 0 END) AS BIGINT) AS predicted
        FROM cls, cm GROUP BY cls.c),
pc1 AS (SELECT *, CASE WHEN predicted > 0 THEN tp / predicted ELSE 0.0 END AS precision,
               CASE WHEN support > 0 THEN tp / support ELSE 0.0 END AS recall FROM pc0),
pc AS (SELECT *, CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall)
                      ELSE 0.0 END AS f1_score FROM pc1)
"""


@register("confusion", _CM + "SELECT true_class, pred_class, n FROM cm")
def confusion(spark, sf):
    return E.confusion_matrix(scored(spark, sf), "truth", "pred")


@register("confusion_pct", _CM + """
SELECT true_class, pred_class, n,
       round(n / sum(n) OVER (PARTITION BY true_class), 6) AS row_share FROM cm""")
def confusion_pct(spark, sf):
    return E.confusion_pct(E.confusion_matrix(scored(spark, sf), "truth", "pred"))


@register("class_report", _CM + """
SELECT class, round(precision, 6) AS precision, round(recall, 6) AS recall,
       round(f1_score, 6) AS f1_score, support FROM pc
UNION ALL
SELECT 'accuracy', NULL, NULL, round(sum(tp) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM pc
UNION ALL
SELECT 'macro avg', round(avg(precision), 6), round(avg(recall), 6), round(avg(f1_score), 6),
       CAST(sum(support) AS BIGINT) FROM pc
UNION ALL
SELECT 'weighted avg', round(sum(precision * support) / sum(support), 6),
       round(sum(recall * support) / sum(support), 6), round(sum(f1_score * support) / sum(support), 6),
       CAST(sum(support) AS BIGINT) FROM pc""")
def class_report(spark, sf):
    return E.class_report(scored(spark, sf), "truth", "pred")


@register("weighted_metrics", _CM + """
, a AS (SELECT CAST(sum(support) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS c,
          CAST(sum(support * predicted) AS DOUBLE) AS tps, CAST(sum(predicted * predicted) AS DOUBLE) AS pp,
          CAST(sum(support * support) AS DOUBLE) AS tt, sum(precision * support) AS wp,
          sum(recall * support) AS wr, sum(f1_score * support) AS wf FROM pc)
SELECT round(c / n, 6) AS accuracy, round(wp / n, 6) AS precision, round(wr / n, 6) AS recall,
       round(wf / n, 6) AS f1_score,
       round(CASE WHEN sqrt((n * n - pp) * (n * n - tt)) > 0
                  THEN (c * n - tps) / sqrt((n * n - pp) * (n * n - tt)) ELSE 0.0 END, 6) AS matthews_corrcoef,
       round(CASE WHEN tps / (n * n) <> 1 THEN (c / n - tps / (n * n)) / (1 - tps / (n * n)) END, 6) AS cohen_kappa
FROM a""")
def weighted_metrics(spark, sf):
    return E.summary_metrics(scored(spark, sf), "truth", "pred")


@register("within_class", _CM + """
SELECT class, round(recall, 6) AS accuracy, CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END::DOUBLE AS precision,
       round(recall, 6) AS recall, round(2 * recall / (1 + recall), 6) AS f1_score
FROM pc WHERE support > 0""")
def within_class(spark, sf):
    return E.within_class(scored(spark, sf), "truth", "pred")


_CM_NULL = _CM.replace("CASE WHEN l_quantity < 17", "CASE WHEN l_linenumber = 2 THEN '(none)' WHEN l_quantity < 17").replace(
    "l_returnflag AS t", "coalesce(nullif(l_returnflag, 'R'), '(none)') AS t")


@register("metrics_unscored", _CM_NULL + """
, a AS (SELECT CAST(sum(support) AS DOUBLE) AS n, CAST(sum(tp) AS DOUBLE) AS c FROM pc)
SELECT true_class, pred_class, n, (SELECT round(c / n, 6) FROM a) AS accuracy FROM cm""")
def metrics_unscored(spark, sf):
    """Rows without truth (here flag R) or prediction (line 2) are counted, as a class of their own."""
    q = F.col("l_quantity")
    rows = S.lineitem(spark, sf).select(
        F.when(F.col("l_returnflag") != "R", F.col("l_returnflag")).alias("truth"),
        F.when(F.col("l_linenumber") == 2, None).when(q < 17, "A").when(q < 34, "N").otherwise("R").alias("pred"))
    accuracy = E.summary_metrics(rows, "truth", "pred").select("accuracy")
    return E.confusion_matrix(rows, "truth", "pred").crossJoin(F.broadcast(accuracy))   # one row


_OVR = """
WITH o AS (
  SELECT 'A' AS class, l_quantity / 50.0 AS score, CAST(l_returnflag = 'A' AS BIGINT) AS pos FROM lineitem
  UNION ALL SELECT 'N', 1 - l_discount * 10, CAST(l_returnflag = 'N' AS BIGINT) FROM lineitem
  UNION ALL SELECT 'R', l_tax * 12.5, CAST(l_returnflag = 'R' AS BIGINT) FROM lineitem),
g AS (SELECT class, score, CAST(sum(pos) AS BIGINT) AS tp, CAST(sum(1 - pos) AS BIGINT) AS fp
      FROM o GROUP BY class, score),
c AS (SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum,
        sum(tp) OVER (PARTITION BY class) AS P, sum(fp) OVER (PARTITION BY class) AS N
      FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


def _long(spark, sf):
    return E.one_vs_rest(scored(spark, sf), "truth", CLASSES)


@register("roc_points", _OVR + """
SELECT class, score AS threshold, round(CASE WHEN N > 0 THEN fp_cum / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN tp_cum / P END, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM g""")
def roc_points(spark, sf):
    return E.roc_points(_long(spark, sf))


@register("auc", _OVR + """
SELECT class, round(sum((CASE WHEN N > 0 THEN fp / N END) * (CASE WHEN P > 0 THEN (2 * tp_cum - tp) / (2 * P) END)), 6) AS auc
FROM c GROUP BY class""")
def auc(spark, sf):
    return E.auc(_long(spark, sf))


@register("pr_points", _OVR + """
SELECT class, score AS threshold, round(CASE WHEN P > 0 THEN tp_cum / P END, 6) AS recall,
       round(tp_cum / (tp_cum + fp_cum), 6) AS precision FROM c
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 1.0::DOUBLE FROM g""")
def pr_points(spark, sf):
    return E.pr_points(_long(spark, sf))


@register("score_histogram", """
SELECT true_class, bin, n, round(n / (sum(n) OVER (PARTITION BY true_class) * 0.05::DOUBLE), 6) AS density
FROM (SELECT l_returnflag AS true_class,
        CAST(least(19, floor(l_quantity / 50.0 * 20)) AS INTEGER) AS bin, count(*) AS n
      FROM lineitem GROUP BY ALL)""")
def score_histogram(spark, sf):
    return E.score_histogram(scored(spark, sf), "truth", "score_a")


@register("score_kde", """
WITH d AS (SELECT l_returnflag AS true_class, l_quantity / 50.0 AS s, count(*) AS cnt FROM lineitem GROUP BY ALL),
st AS (SELECT l_returnflag AS true_class, count(*) AS n,
         stddev_samp(l_quantity / 50.0) * pow(CAST(count(*) AS DOUBLE), -0.2) AS h
       FROM lineitem GROUP BY ALL),
g AS (SELECT CAST(i AS DOUBLE) / 50.0::DOUBLE AS grid FROM range(0, 51) t(i))
SELECT d.true_class, g.grid,
       round(sum(d.cnt * exp(-0.5 * ((g.grid - d.s) / st.h) * ((g.grid - d.s) / st.h)))
             / (any_value(st.n) * any_value(st.h) * sqrt(2 * pi())), 6) AS density
FROM d JOIN st USING (true_class) CROSS JOIN g GROUP BY d.true_class, g.grid""")
def score_kde(spark, sf):
    return E.score_kde(scored(spark, sf), "truth", "score_a")


# ---- binary case: truth = labels.quality (1 positive), score = a rule on documents ------
def _binary_long(spark, sf):
    from flowlens.sources.tables import table
    docs = table(spark, sf, "documents").select("doc_id", "n_chars")
    lab = table(spark, sf, "labels").select("doc_id", "quality")
    # inner join on the label key: only labelled documents have a truth
    j = docs.join(lab, "doc_id").select(
        F.col("quality").cast("string").alias("truth"),
        F.least(F.lit(1.0), F.col("n_chars") / 10000.0).alias("score_1"))
    return E.one_vs_rest(j, "truth", {"1": "score_1"})


_BIN = """
WITH o AS (SELECT '1' AS class, least(1.0, d.n_chars / 10000.0) AS score,
                  CAST(l.quality = 1 AS BIGINT) AS pos
           FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT class, score, CAST(sum(pos) AS BIGINT) AS tp, CAST(sum(1 - pos) AS BIGINT) AS fp
      FROM o GROUP BY class, score),
c AS (SELECT *, sum(tp) OVER w AS tp_cum, sum(fp) OVER w AS fp_cum,
        sum(tp) OVER (PARTITION BY class) AS P, sum(fp) OVER (PARTITION BY class) AS N
      FROM g WINDOW w AS (PARTITION BY class ORDER BY score DESC ROWS UNBOUNDED PRECEDING))
"""


@register("binary_roc", _BIN + """
SELECT class, score AS threshold, round(CASE WHEN N > 0 THEN fp_cum / N END, 6) AS fpr,
       round(CASE WHEN P > 0 THEN tp_cum / P END, 6) AS tpr FROM c
UNION ALL SELECT DISTINCT class, CAST(NULL AS DOUBLE), 0.0::DOUBLE, 0.0::DOUBLE FROM g""")
def binary_roc(spark, sf):
    """A27 binary: ROC of the positive class (column 1) for document quality."""
    return E.roc_points(_binary_long(spark, sf))


@register("binary_auc", _BIN + """
SELECT class, round(sum((CASE WHEN N > 0 THEN fp / N END) * (CASE WHEN P > 0 THEN (2 * tp_cum - tp) / (2 * P) END)), 6) AS auc
FROM c GROUP BY class""")
def binary_auc(spark, sf):
    """A28 binary."""
    return E.auc(_binary_long(spark, sf))
