"""Evaluation tables.

Classification metrics: one group-by of (truth, prediction) over the scored table, then
everything else works on that C x C table (tiny). Curves: one group-by of (class, score)
collapses ties (and hot scores) map-side; the cumulative sums run through
``windows.running_sum`` (bucketed, so one class never lands in a single task).
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.joins import fetch_bounded, join_small, materialize_small
from flowlens.operators.windows import running_sum
from flowlens.session import cut_lineage

MAX_CLASSES = 10_000
NO_CLASS = "(none)"
CELL_LIMIT = 200_000  # non-zero confusion cells kept as a local table
CURVE_BUCKETS = 64  # equal-depth buckets per class for the ROC / PR running sums


def _classes(counts: DataFrame) -> list[str]:
    """Sorted union of true and predicted classes (bounded, checked)."""
    rows = (counts.select(F.col("true_class").alias("c"))
            .union(counts.select(F.col("pred_class").alias("c"))).distinct()
            .limit(MAX_CLASSES + 1).collect())
    if len(rows) > MAX_CLASSES:
        raise ValueError(f"more than {MAX_CLASSES} classes")
    return sorted(r["c"] for r in rows if r["c"] is not None)


def confusion_counts(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Non-zero cells (true_class, pred_class, n): the only pass over the scored rows.

    A row without truth or prediction is counted in a class of its own, ``NO_CLASS``: an
    unscored row is a wrong one, never a missing one."""
    named = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(NO_CLASS))
    return df.groupBy(named(truth).alias("true_class"), named(pred).alias("pred_class")).agg(
        F.count(F.lit(1)).alias("n"))


def confusion_matrix(df: DataFrame, truth: str, pred: str) -> DataFrame:
    """Every (true, predicted) cell of the class set, absent cells 0.

    The non-zero cells (at most classes^2 rows, bounded) are computed once and kept as a
    local table; the class list and the grid join both read that copy."""
    counts = confusion_counts(df, truth, pred)
    local = fetch_bounded(counts, CELL_LIMIT)
    if local is not None:
        counts = local
    classes = _classes(counts)
    grid = df.sparkSession.createDataFrame(
        [(t, p) for t in classes for p in classes], "true_class string, pred_class string")
    return join_small(grid, counts, on=["true_class", "pred_class"], how="left").select(
        "true_class", "pred_class", F.coalesce(F.col("n"), F.lit(0)).cast("long").alias("n"))


def confusion_pct(cm: DataFrame, digits: int = 6) -> DataFrame:
    """Cell / row sum (NULL for a class that never occurs in truth)."""
    row = F.sum("n").over(Window.partitionBy("true_class"))
    return cm.withColumn("row_share", F.round(F.try_divide(F.col("n"), row), digits))


def per_class(cm: DataFrame) -> DataFrame:
    """class, tp, support (true count), predicted count, precision, recall, f1."""
    t = cm.groupBy(F.col("true_class").alias("class")).agg(
        F.sum("n").alias("support"), F.sum(F.when(F.col("true_class") == F.col("pred_class"),
                                                  F.col("n")).otherwise(0)).alias("tp"))
    p = cm.groupBy(F.col("pred_class").alias("class")).agg(F.sum("n").alias("predicted"))
    j = t.join(p, "class", "full")
    j = j.select("class", F.coalesce("tp", F.lit(0)).alias("tp"),
                 F.coalesce("support", F.lit(0)).alias("support"),
                 F.coalesce("predicted", F.lit(0)).alias("predicted"))
    prec = F.when(F.col("predicted") > 0, F.col("tp") / F.col("predicted")).otherwise(0.0)
    rec = F.when(F.col("support") > 0, F.col("tp") / F.col("support")).otherwise(0.0)
    j = j.withColumns({"precision": prec, "recall": rec})
    f1 = F.when(F.col("precision") + F.col("recall") > 0,
                2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall"))
                ).otherwise(0.0)
    return j.withColumn("f1_score", f1)


def class_report(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """Per-class precision/recall/F1/support, plus accuracy, macro and weighted rows."""
    pc = per_class(confusion_matrix(df, truth, pred))
    r = lambda c: F.round(c, digits)
    classes = pc.select("class", r(F.col("precision")).alias("precision"),
                        r(F.col("recall")).alias("recall"), r(F.col("f1_score")).alias("f1_score"),
                        F.col("support").cast("long").alias("support"))
    n = F.sum("support")
    summary = pc.agg(
        r(F.try_divide(F.sum("tp"), n)).alias("acc"),
        r(F.avg("precision")).alias("mp"), r(F.avg("recall")).alias("mr"),
        r(F.avg("f1_score")).alias("mf"),
        r(F.try_divide(F.sum(F.col("precision") * F.col("support")), n)).alias("wp"),
        r(F.try_divide(F.sum(F.col("recall") * F.col("support")), n)).alias("wr"),
        r(F.try_divide(F.sum(F.col("f1_score") * F.col("support")), n)).alias("wf"),
        n.cast("long").alias("n"))
    rows = summary.select(F.explode(F.array(
        F.struct(F.lit("accuracy").alias("class"), F.lit(None).cast("double").alias("precision"),
                 F.lit(None).cast("double").alias("recall"), F.col("acc").alias("f1_score"),
                 F.col("n").alias("support")),
        F.struct(F.lit("macro avg").alias("class"), F.col("mp").alias("precision"),
                 F.col("mr").alias("recall"), F.col("mf").alias("f1_score"),
                 F.col("n").alias("support")),
        F.struct(F.lit("weighted avg").alias("class"), F.col("wp").alias("precision"),
                 F.col("wr").alias("recall"), F.col("wf").alias("f1_score"),
                 F.col("n").alias("support")),
    )).alias("s")).select("s.*")
    return classes.unionByName(rows)


def summary_metrics(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """Accuracy, weighted P/R/F1, MCC and Cohen's kappa (one row)."""
    pc = per_class(confusion_matrix(df, truth, pred))
    agg = pc.agg(F.sum("support").cast("double").alias("n"), F.sum("tp").cast("double").alias("c"),
                 F.sum(F.col("support") * F.col("predicted")).cast("double").alias("tp_sum"),
                 F.sum(F.col("predicted") * F.col("predicted")).cast("double").alias("pp"),
                 F.sum(F.col("support") * F.col("support")).cast("double").alias("tt"),
                 F.sum(F.col("precision") * F.col("support")).alias("wp"),
                 F.sum(F.col("recall") * F.col("support")).alias("wr"),
                 F.sum(F.col("f1_score") * F.col("support")).alias("wf"))
    n, c = F.col("n"), F.col("c")
    den = F.sqrt((n * n - F.col("pp")) * (n * n - F.col("tt")))
    mcc = F.when(den > 0, (c * n - F.col("tp_sum")) / den).otherwise(0.0)
    pe = F.try_divide(F.col("tp_sum"), n * n)  # NULL on an empty input
    kappa = F.when(pe != 1, (F.try_divide(c, n) - pe) / (1 - pe))
    r = lambda x: F.round(x, digits)
    return agg.select(r(F.try_divide(c, n)).alias("accuracy"),
                      r(F.try_divide(F.col("wp"), n)).alias("precision"),
                      r(F.try_divide(F.col("wr"), n)).alias("recall"),
                      r(F.try_divide(F.col("wf"), n)).alias("f1_score"),
                      r(mcc).alias("matthews_corrcoef"), r(kappa).alias("cohen_kappa"))


def within_class(df: DataFrame, truth: str, pred: str, digits: int = 6) -> DataFrame:
    """Metrics on the rows of one true class: accuracy = recall r, weighted precision
    = 1 (0 when r = 0), F1 = 2r / (1 + r)."""
    pc = per_class(confusion_matrix(df, truth, pred)).where(F.col("support") > 0)
    rc = F.col("recall")
    return pc.select("class", F.round(rc, digits).alias("accuracy"),
                     F.when(rc > 0, 1.0).otherwise(0.0).alias("precision"),
                     F.round(rc, digits).alias("recall"),
                     F.round(2 * rc / (1 + rc), digits).alias("f1_score"))


# ---- curves -------------------------------------------------------------------------
def one_vs_rest(df: DataFrame, truth: str, scores: dict[str, str]) -> DataFrame:
    """(class, score, pos, neg) per row and class: the long form of OvR scoring."""
    structs = [F.struct(F.lit(k).alias("class"), F.col(s).cast("double").alias("score"),
                        (F.col(truth) == k).cast("long").alias("pos"))
               for k, s in scores.items()]
    return df.select(F.explode(F.array(*structs)).alias("r")).select(
        "r.class", "r.score", "r.pos", (1 - F.col("r.pos")).alias("neg"))


def curve_counts(long: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Per (class, distinct score): tp, fp, their cumulative sums from the top score down,
    and the class totals P, N. Returns (points, totals).

    The (class, score) aggregate is the reduced input of several small jobs (bucket
    ranges, bucket offsets, totals), so it is checkpointed once into the shared
    checkpoint folder instead of re-scanning the source for each of them."""
    g = cut_lineage(long.groupBy("class", "score").agg(F.sum("pos").alias("tp"),
                                                        F.sum("neg").alias("fp")))
    # per class, in one small aggregation: totals and equal-depth bucket boundaries over
    # the distinct scores (approximate quantiles), so running-sum tasks stay balanced
    # however the scores are distributed
    nb = CURVE_BUCKETS
    fracs = [i / nb for i in range(1, nb)]
    stats = materialize_small(g.groupBy("class").agg(
        F.array_distinct(F.percentile_approx("score", fracs, 10000)).alias("__bounds"),
        F.sum("tp").alias("P"), F.sum("fp").alias("N")), MAX_CLASSES)
    cum = running_sum(g, ["class"], "score", ["tp", "fp"], desc=True, bounds=stats)
    totals = stats.select("class", "P", "N")
    return cum.join(F.broadcast(totals), on="class", how="inner"), totals


def roc_points(long: DataFrame, digits: int = 6) -> DataFrame:
    """(class, threshold, fpr, tpr) per distinct score, preceded by (0, 0)."""
    c, totals = curve_counts(long)
    pts = c.select("class", F.col("score").alias("threshold"),
                   F.round(F.try_divide(F.col("fp_cum"), F.col("N")), digits).alias("fpr"),
                   F.round(F.try_divide(F.col("tp_cum"), F.col("P")), digits).alias("tpr"))
    start = totals.select("class", F.lit(None).cast("double").alias("threshold"),
                          F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(start)


def auc(long: DataFrame, digits: int = 6) -> DataFrame:
    """Trapezoid area under the ROC points; each distinct score adds
    fp/N * (tp_cum + (tp_cum - tp)) / (2P), so no lag is needed."""
    c, _ = curve_counts(long)
    term = F.try_divide(F.col("fp"), F.col("N")) * F.try_divide(
        2 * F.col("tp_cum") - F.col("tp"), 2 * F.col("P"))
    return c.groupBy("class").agg(F.round(F.sum(term), digits).alias("auc"))


def pr_points(long: DataFrame, digits: int = 6) -> DataFrame:
    """(class, threshold, recall, precision) per distinct score, plus the closing
    point recall 0 / precision 1."""
    c, totals = curve_counts(long)
    pts = c.select("class", F.col("score").alias("threshold"),
                   F.round(F.try_divide(F.col("tp_cum"), F.col("P")), digits).alias("recall"),
                   F.round(F.col("tp_cum") / (F.col("tp_cum") + F.col("fp_cum")), digits)
                   .alias("precision"))
    end = totals.select("class", F.lit(None).cast("double").alias("threshold"),
                        F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(end)


def score_histogram(df: DataFrame, truth: str, score: str, bins: int = 20,
                    digits: int = 6) -> DataFrame:
    """Density histogram of ``score`` on [0, 1] per true class, each normalised alone."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(score) * bins)).cast("int")
    g = df.groupBy(F.col(truth).alias("true_class"), b.alias("bin")).agg(
        F.count(F.lit(1)).alias("n"))
    n_class = F.sum("n").over(Window.partitionBy("true_class"))
    return g.withColumn("density", F.round(F.col("n") / (n_class * (1.0 / bins)), digits))


def score_kde(df: DataFrame, truth: str, score: str, points: int = 51,
              digits: int = 6) -> DataFrame:
    """Gaussian KDE of ``score`` per true class on a grid over [0, 1]; bandwidth
    sd * n^(-1/5) (Scott). Distinct scores are counted first, so the grid expansion is
    over (class, distinct score) rows, not raw rows."""
    cls = F.col(truth).alias("true_class")
    distinct = df.groupBy(cls, F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("cnt"))
    stats = df.groupBy(cls).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp(score).alias("sd"))
    stats = stats.withColumn("h", F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2)))
    j = join_small(distinct, stats, on="true_class", how="inner")
    g = j.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))) \
        .withColumn("grid", F.col("i") / float(points - 1))
    z = F.try_divide(F.col("grid") - F.col("s"), F.col("h"))  # h = 0: one distinct score
    k = F.col("cnt") * F.exp(-0.5 * z * z)
    out = g.groupBy("true_class", "grid").agg(
        F.try_divide(F.sum(k), F.first("n") * F.first("h") * math.sqrt(2 * math.pi)).alias("density"))
    return out.select("true_class", "grid", F.round("density", digits).alias("density"))
