"""Feature engineering (F11-F18): interactions and ratios of correlated pairs, polynomial
terms, row statistics, signed log of extreme-scale columns. All map-only expressions;
the only jobs are the small statistics that pick the columns (pairs, maxima)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from flowlens.functions import fixed
from flowlens.functions import scalar as X
from flowlens.operators.profile import abs_correlations

MAX_PAIRS = 100_000


def high_corr_pairs(df: DataFrame, cols: Sequence[str],
                    threshold: float = fixed.INTERACTION_CORR) -> list[tuple[str, str]]:
    """Pairs (i < j) with |corr| > threshold; bounded by len(cols)^2 (checked)."""
    rows = (abs_correlations(df, cols).where(F.col("abs_corr") > threshold)
            .orderBy("pos_a", "pos_b").limit(MAX_PAIRS + 1).collect())
    if len(rows) > MAX_PAIRS:
        raise ValueError("too many correlated pairs")
    return [(r["feature_a"], r["feature_b"]) for r in rows]


def interactions_long(df: DataFrame, keys: Sequence[str], pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """F12-F13 in long form: one row per (row, pair) with a*b and a/(b+1e-6)."""
    structs = [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"),
                        (F.col(a) * F.col(b)).alias("interaction"),
                        X.ratio(F.col(a), F.col(b)).alias("ratio")) for a, b in pairs]
    if not structs:
        return df.select(*keys, F.lit(None).cast("string").alias("feature_a"),
                         F.lit(None).cast("string").alias("feature_b"),
                         F.lit(None).cast("double").alias("interaction"),
                         F.lit(None).cast("double").alias("ratio")).limit(0)
    return df.select(*keys, F.explode(F.array(*structs)).alias("p")).select(*keys, "p.*")


def interactions_wide(df: DataFrame, pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """F12-F13 as new columns ``{a}_{b}_interaction`` / ``{a}_{b}_ratio``."""
    out = {}
    for a, b in pairs:
        out[f"{a}_{b}_interaction"] = F.col(a) * F.col(b)
        out[f"{a}_{b}_ratio"] = X.ratio(F.col(a), F.col(b))
    return df.withColumns(out)


def polynomial(df: DataFrame, cols: Sequence[str], first: int = 10) -> DataFrame:
    """square and cube of the first ``first`` columns."""
    out = {}
    for c in list(cols)[:first]:
        out[f"{c}_squared"] = F.col(c) * F.col(c)
        out[f"{c}_cubed"] = F.col(c) * F.col(c) * F.col(c)
    return df.withColumns(out)


def row_stats(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Row mean, std (population over originals), max, min.
    max is over originals + mean + std; min over originals + mean + std + max."""
    vals = [F.col(c) for c in cols]
    mean = X.row_mean(vals)
    std = X.row_std(vals)
    return df.withColumns({"row_mean": mean, "row_std": std}).withColumns({
        "row_max": F.greatest(*vals, F.col("row_mean"), F.col("row_std"))}).withColumns({
            "row_min": F.least(*vals, F.col("row_mean"), F.col("row_std"), F.col("row_max"))})


def extreme_columns(df: DataFrame, cols: Sequence[str],
                    threshold: float = fixed.EXTREME_ABS) -> list[str]:
    """A11 selection: columns with |max| > threshold (one aggregation, one small row)."""
    r = df.agg(*[F.abs(F.max(c)).alias(c) for c in cols]).first()
    return [c for c in cols if r[c] is not None and r[c] > threshold]


def signed_log_columns(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """F11 applied to ``cols``."""
    return df.withColumns({c: X.signed_log(F.col(c)) for c in cols})
