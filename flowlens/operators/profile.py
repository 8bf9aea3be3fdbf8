"""Feature profiling: cardinality, dominance, constants, increments, correlation, variance,
scale, mutual information (A4-A11, A40, W1, F19).

Many-column statistics are computed as ONE aggregation (or one unpivot + group-by), never
a per-column job loop. Results are small (one row per feature or feature pair).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions import fixed
from flowlens.operators.clean import unpivot_long
from flowlens.operators.joins import join_small
from flowlens.operators.windows import global_lag


def _one_row_long(row_df: DataFrame, stats: dict[str, list[str]], feature_order: Sequence[str]) -> DataFrame:
    """Turn a one-row frame of ``{stat}__{feature}`` columns into one row per feature."""
    structs = [F.struct(F.lit(f).alias("feature"), F.lit(i).alias("position"),
                        *[F.col(f"{s}__{f}").alias(s) for s in stats[f]])
               for i, f in enumerate(feature_order)]
    return row_df.select(F.explode(F.array(*structs)).alias("r")).select("r.*")


def value_profile(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """A4-A6 in one pass: per feature n_rows, n_distinct (NULL/NaN excluded), top_count.

    unpivot -> group by (feature, value) with map-side partial counts (a value holding a
    third of all rows collapses to one partial row per task) -> group by feature."""
    long = unpivot_long(df, [], cols)
    valid = F.col("value").isNotNull() & ~F.isnan(F.col("value"))
    per_value = long.groupBy("feature", "value").agg(F.count(F.lit(1)).alias("cnt"))
    return per_value.groupBy("feature").agg(
        F.sum("cnt").alias("n_rows"),
        F.count_if(valid).alias("n_distinct"),
        F.coalesce(F.max(F.when(valid, F.col("cnt"))), F.lit(0)).alias("top_count"))


def distinct_ratio(df: DataFrame, cols: Sequence[str],
                   threshold: float = fixed.HIGH_CARDINALITY_RATIO) -> DataFrame:
    """A4: unique ratio per feature and the high-cardinality flag (> threshold)."""
    p = value_profile(df, cols)
    r = F.col("n_distinct") / F.col("n_rows")
    return p.select("feature", "n_rows", "n_distinct", F.round(r, 6).alias("distinct_ratio"),
                    (r > threshold).alias("high_cardinality"))


def dominant_value(df: DataFrame, cols: Sequence[str],
                   share: float = fixed.DOMINANT_SHARE) -> DataFrame:
    """A5: share of the most frequent value; skewed when >1 distinct and share > .999."""
    p = value_profile(df, cols)
    s = F.col("top_count") / F.col("n_rows")
    return p.select("feature", "top_count", F.round(s, 6).alias("top_share"),
                    ((F.col("n_distinct") > 1) & (s > share)).alias("highly_skewed"))


def constant_features(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Keep features with more than one distinct value."""
    p = value_profile(df, cols)
    return p.select("feature", "n_distinct", (F.col("n_distinct") > 1).alias("keep"))


def perfect_increments(df: DataFrame, order: str, cols: Sequence[str],
                       n_buckets: int | None = None) -> DataFrame:
    """Per column, the number of distinct row-to-row differences in ``order`` order;
    exactly one means 'perfect increments' (a constant column also qualifies).

    The global lag is bucketed (see ``windows.global_lag``), so no single task sorts
    the whole table."""
    lagged = global_lag(df.select(order, *cols), order, cols, n_buckets)
    diffs = lagged.select(*[(F.col(c) - F.col(f"{c}_prev")).cast("double").alias(c) for c in cols])
    long = unpivot_long(diffs, [], cols, "feature", "diff").where(
        F.col("diff").isNotNull() & ~F.isnan("diff"))
    n = long.groupBy("feature", "diff").agg(F.count(F.lit(1)).alias("c")) \
        .groupBy("feature").agg(F.count(F.lit(1)).alias("n_distinct_diffs"))
    return n.select("feature", "n_distinct_diffs",
                    (F.col("n_distinct_diffs") == 1).alias("perfect_increments"))


def name_flags(cols: Sequence[str]) -> list[tuple[str, bool, bool]]:
    """(column, temporal-like, id-like) by case-insensitive substring of the name."""
    out = []
    for c in cols:
        low = c.lower()
        out.append((c, any(w in low for w in fixed.TEMPORAL_WORDS),
                    any(w in low for w in fixed.ID_WORDS)))
    return out


def abs_correlations(df: DataFrame, cols: Sequence[str], digits: int = 6) -> DataFrame:
    """|Pearson| for every pair i < j (upper triangle) over the rows where both are there
    (NULL and NaN are missing, pair by pair); NULL where one of them is constant there.

    Two passes for any width: one aggregation gives each column's centre, then every task
    adds up the moments of all pairs (one row per pair and task) and Spark sums them."""
    cols = list(cols)
    k = len(cols)
    given = df.select(*[F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double")).alias(f"x{i}")
                        for i, c in enumerate(cols)])
    mid = given.agg(*[F.struct(F.avg(c).alias("m"), F.min(c).alias("lo"), F.max(c).alias("hi")).alias(c)
                      for c in given.columns]).first()
    centre = [0.0 if r.m is None else r.lo if r.lo == r.hi else r.m for r in mid]

    def moments(batches):
        import numpy as np
        import pyarrow as pa

        total = None
        for batch in batches:
            x = np.column_stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch.columns])
            there = ~np.isnan(x)
            x = np.where(there, x - centre, 0.0)
            one = there.astype(float)
            part = np.stack([one.T @ one, x.T @ one, one.T @ x, (x * x).T @ one, one.T @ (x * x), x.T @ x])
            total = part if total is None else total + part
        if total is not None:
            i, j = np.triu_indices(k, 1)
            yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), *(
                pa.array(t[i, j]) for t in total)], names=["i", "j", "n", "a", "b", "aa", "bb", "ab"])

    sums = (given.mapInArrow(moments, "i int, j int, n double, a double, b double, aa double, bb double, ab double")
            .groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "a", "b", "aa", "bb", "ab")]))
    var_a, var_b = F.expr("aa - a * try_divide(a, n)"), F.expr("bb - b * try_divide(b, n)")
    corr = F.try_divide(F.expr("ab - a * try_divide(b, n)"), F.sqrt(F.greatest(var_a, F.lit(0.0)) * F.greatest(var_b, F.lit(0.0))))
    pairs = df.sparkSession.createDataFrame(
        [(cols[i], cols[j], i, j) for i in range(k) for j in range(i + 1, k)],
        "feature_a string, feature_b string, pos_a int, pos_b int")
    j = pairs.join(sums, (F.col("pos_a") == F.col("i")) & (F.col("pos_b") == F.col("j")), "left")
    return j.select("feature_a", "feature_b", "pos_a", "pos_b", F.round(F.abs(corr), digits).alias("abs_corr"))


def correlated_pairs(df: DataFrame, cols: Sequence[str],
                     threshold: float = fixed.INTERACTION_CORR) -> DataFrame:
    """Pairs with |corr| > threshold."""
    return abs_correlations(df, cols).where(F.col("abs_corr") > threshold)


def correlated_drop(df: DataFrame, cols: Sequence[str],
                    threshold: float = fixed.REDUNDANT_CORR) -> DataFrame:
    """Drop a column when ANY earlier column (dropped or not) has |corr| > threshold."""
    pairs = abs_correlations(df, cols)
    worst = pairs.groupBy("feature_b").agg(F.max("abs_corr").alias("max_corr_earlier"))
    feats = df.sparkSession.createDataFrame(
        [(c, i) for i, c in enumerate(cols)], "feature string, position int")
    j = join_small(feats, worst.withColumnRenamed("feature_b", "feature"), on="feature", how="left")
    return j.select("feature", "position", "max_corr_earlier",
                    F.coalesce(F.col("max_corr_earlier") > threshold, F.lit(False)).alias("dropped"))


def variance_keep(df: DataFrame, cols: Sequence[str], threshold: float = fixed.VARIANCE_MIN,
                  digits: int = 6) -> DataFrame:
    """A10: population variance per column (one agg), keep when > threshold."""
    row = df.agg(*[F.var_pop(c).alias(f"var_pop__{c}") for c in cols])
    long = _one_row_long(row, {c: ["var_pop"] for c in cols}, cols)
    return long.select("feature", F.round("var_pop", digits).alias("var_pop"),
                       (F.col("var_pop") > threshold).alias("keep"))


def scale_summary(df: DataFrame, cols: Sequence[str], threshold: float = fixed.EXTREME_ABS,
                  digits: int = 6) -> DataFrame:
    """describe()-style stats (sample std) per column in one agg; flag |max(x)| > threshold."""
    aggs = []
    for c in cols:
        aggs += [F.count(c).alias(f"count__{c}"), F.avg(c).alias(f"mean__{c}"),
                 F.stddev_samp(c).alias(f"std__{c}"), F.min(c).alias(f"min__{c}"),
                 F.max(c).alias(f"max__{c}"), F.abs(F.max(c)).alias(f"maxabs__{c}")]
    row = df.agg(*aggs)
    stats = ["count", "mean", "std", "min", "max", "maxabs"]
    long = _one_row_long(row, {c: stats for c in cols}, cols)
    return long.select("feature", "count", F.round("mean", digits).alias("mean"),
                       F.round("std", digits).alias("std"),
                       F.col("min").cast("double").alias("min"),
                       F.col("max").cast("double").alias("max"),
                       (F.col("maxabs") > threshold).alias("extreme_scale"))


def mutual_information(df: DataFrame, cols: Sequence[str], label: str, bins: int = 10,
                       threshold: float = fixed.MI_MIN, digits: int = 6) -> DataFrame:
    """MI(feature; class) with ``bins`` equal-width bins from each feature's min/max,
    natural log. One small aggregation gives the ranges (one row, inlined as literals);
    binning is then a projection, and the joint counts come from one group-by over the
    unpivoted bins (map-side partial counts)."""
    r = df.agg(*[F.min(c).alias(f"lo__{c}") for c in cols],
               *[F.max(c).alias(f"hi__{c}") for c in cols]).first()
    binned = {}
    for c in cols:
        lo, hi = r[f"lo__{c}"], r[f"hi__{c}"]
        if lo is None or hi is None or hi - lo <= 0:
            b = F.when(F.col(c).isNotNull(), F.lit(0))
        else:
            b = F.least(F.lit(bins - 1), F.floor((F.col(c) - F.lit(float(lo)))
                                                 / F.lit(float(hi - lo)) * bins))
        binned[c] = b.cast("int")
    long = df.select(label, *[binned[c].alias(c) for c in cols]).unpivot(
        [label], list(cols), "feature", "bin").where(F.col("bin").isNotNull())
    joint = long.groupBy("feature", "bin", label).agg(F.count(F.lit(1)).alias("n_xy"))
    n = F.sum("n_xy").over(Window.partitionBy("feature"))
    nx = F.sum("n_xy").over(Window.partitionBy("feature", "bin"))
    ny = F.sum("n_xy").over(Window.partitionBy("feature", label))
    terms = joint.select("feature", (F.col("n_xy") / n *
                                     F.log(F.col("n_xy") * n / (nx * ny))).alias("t"))
    mi = terms.groupBy("feature").agg(F.sum("t").alias("mi"))
    return mi.select("feature", F.round("mi", digits).alias("mutual_information"),
                     (F.col("mi") > threshold).alias("selected"))
