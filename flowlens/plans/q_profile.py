"""Profiling, redundancy and feature-engineering queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import fixed
from flowlens.operators import features as FE
from flowlens.operators import profile as P
from flowlens.plans import standins as S
from flowlens.plans.registry import register
from flowlens.sources.tables import table

KEY = ", ".join(S.LINE_KEY)
# lineitem measures plus two derived ones: net price (corr ~.998 with price) and
# quantity x tax (~.64 with tax); the base columns alone are uncorrelated.
PROF_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax", "net_price", "qty_tax"]
SCALE_COLS = PROF_COLS + ["gross"]
EVENT_COLS = ["event_id", "user_id", "value"]


def measures(spark, sf):
    li = S.lineitem(spark, sf)
    return li.select(*S.LINE_KEY, "l_returnflag", "l_quantity", "l_extendedprice", "l_discount",
                     "l_tax",
                     (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("net_price"),
                     (F.col("l_quantity") * F.col("l_tax")).alias("qty_tax"),
                     (F.col("l_quantity") * F.col("l_extendedprice")).alias("gross"))


MEASURES_SQL = f"""
SELECT {KEY}, l_returnflag, l_quantity, l_extendedprice, l_discount, l_tax,
       l_extendedprice * (1 - l_discount) AS net_price, l_quantity * l_tax AS qty_tax,
       l_quantity * l_extendedprice AS gross
FROM lineitem
"""


def _profile_sql(cols, base):
    parts = []
    for c in cols:
        parts.append(f"""
SELECT '{c}' AS feature, count(*) AS n_rows,
       count(DISTINCT {c}) FILTER (WHERE NOT isnan({c})) AS n_distinct,
       (SELECT coalesce(max(cnt), 0) FROM (SELECT count(*) AS cnt FROM ({base})
          WHERE {c} IS NOT NULL AND NOT isnan({c}) GROUP BY {c})) AS top_count
FROM ({base})""")
    return " UNION ALL ".join(parts)


_PROF = _profile_sql(PROF_COLS, MEASURES_SQL)


@register("distinct_ratio", f"""
SELECT feature, n_rows, n_distinct, round(n_distinct / n_rows, 6) AS distinct_ratio,
       n_distinct / n_rows > {fixed.HIGH_CARDINALITY_RATIO} AS high_cardinality
FROM ({_PROF})
""")
def distinct_ratio(spark, sf):
    return P.distinct_ratio(measures(spark, sf), PROF_COLS)


@register("dominant_value", f"""
SELECT feature, top_count, round(top_count / n_rows, 6) AS top_share,
       n_distinct > 1 AND top_count / n_rows > {fixed.DOMINANT_SHARE} AS highly_skewed
FROM ({_PROF})
""")
def dominant_value(spark, sf):
    return P.dominant_value(measures(spark, sf), PROF_COLS)


@register("constant_features", f"""
SELECT feature, n_distinct, n_distinct > 1 AS keep FROM ({_PROF})
""")
def constant_features(spark, sf):
    return P.constant_features(measures(spark, sf), PROF_COLS)


def _incr_sql():
    parts = []
    for c in EVENT_COLS:
        parts.append(f"""
SELECT '{c}' AS feature, count(DISTINCT d) AS n_distinct_diffs, count(DISTINCT d) = 1 AS perfect_increments
FROM (SELECT CAST({c} - lag({c}) OVER (ORDER BY event_id) AS DOUBLE) AS d FROM events)
WHERE d IS NOT NULL AND NOT isnan(d)""")
    return " UNION ALL ".join(parts)


@register("perfect_increments", _incr_sql())
def perfect_increments(spark, sf):
    ev = table(spark, sf, "events").select(*EVENT_COLS)
    return P.perfect_increments(ev, "event_id", EVENT_COLS)


def _corr_sql(cols, base):
    parts = []
    for i in range(len(cols)):
        for j in range(i + 1, len(cols)):
            a, b = cols[i], cols[j]
            parts.append(f"""
SELECT '{a}' AS feature_a, '{b}' AS feature_b, {i} AS pos_a, {j} AS pos_b,
       round(abs(CASE WHEN isnan(corr({a}, {b})) THEN NULL ELSE corr({a}, {b}) END), 6) AS abs_corr
FROM ({base})""")
    return " UNION ALL ".join(parts)


_CORR = _corr_sql(PROF_COLS, MEASURES_SQL)


@register("correlation_pairs", _CORR)
def correlation_pairs(spark, sf):
    return P.abs_correlations(measures(spark, sf), PROF_COLS)


@register("correlated_pairs", f"SELECT * FROM ({_CORR}) WHERE abs_corr > {fixed.INTERACTION_CORR}")
def correlated_pairs(spark, sf):
    return P.correlated_pairs(measures(spark, sf), PROF_COLS)


# 26 columns with gaps: correlations of each pair over the rows that have both
WIDE_COLS = [f"c{i}" for i in range(26)]
_WIDE = [f"CASE WHEN (l_orderkey + l_linenumber) % {i + 2} <> 0 THEN l_quantity * {i % 5 + 1} + l_discount * {100 * (i % 3)}"
         f" + l_tax * {50 * (i % 4)} - l_extendedprice / 1000 * {i % 7 % 3} END" for i in range(26)]


@register("correlation_wide", f"""
WITH w AS MATERIALIZED (SELECT {', '.join(f'{e} AS {c}' for e, c in zip(_WIDE, WIDE_COLS, strict=True))} FROM lineitem)
""" + _corr_sql(WIDE_COLS, "SELECT * FROM w"))
def correlation_wide(spark, sf):
    li = S.lineitem(spark, sf)
    return P.abs_correlations(li.select(*[F.expr(e).alias(c) for e, c in zip(_WIDE, WIDE_COLS, strict=True)]), WIDE_COLS)


_FEATS_SQL = " UNION ALL ".join(f"SELECT '{c}' AS feature, {i} AS position"
                                for i, c in enumerate(PROF_COLS))


@register("correlated_drop", f"""
SELECT f.feature, f.position, w.max_corr_earlier,
       coalesce(w.max_corr_earlier > {fixed.REDUNDANT_CORR}, false) AS dropped
FROM ({_FEATS_SQL}) f
LEFT JOIN (SELECT feature_b, max(abs_corr) AS max_corr_earlier FROM ({_CORR}) GROUP BY feature_b) w
  ON w.feature_b = f.feature
""")
def correlated_drop(spark, sf):
    return P.correlated_drop(measures(spark, sf), PROF_COLS)


@register("variance_keep", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, round(var_pop({c}), 6) AS var_pop, var_pop({c}) > {fixed.VARIANCE_MIN} AS keep
FROM ({MEASURES_SQL})""" for c in PROF_COLS))
def variance_keep(spark, sf):
    return P.variance_keep(measures(spark, sf), PROF_COLS)


@register("extreme_scale", " UNION ALL ".join(f"""
SELECT '{c}' AS feature, count({c}) AS count, round(avg({c}), 6) AS mean,
       round(stddev_samp({c}), 6) AS std, CAST(min({c}) AS DOUBLE) AS min,
       CAST(max({c}) AS DOUBLE) AS max, abs(max({c})) > {fixed.EXTREME_ABS} AS extreme_scale
FROM ({MEASURES_SQL})""" for c in SCALE_COLS))
def extreme_scale(spark, sf):
    return P.scale_summary(measures(spark, sf), SCALE_COLS)


def _mi_sql():
    unp = (f"SELECT l_returnflag, feature, value FROM (UNPIVOT ({MEASURES_SQL}) ON "
           f"{', '.join(PROF_COLS)} INTO NAME feature VALUE value)")
    rng = " UNION ALL ".join(f"SELECT '{c}' AS feature, min({c}) AS lo, max({c}) AS hi FROM ({MEASURES_SQL})"
                             for c in PROF_COLS)
    return f"""
WITH u AS ({unp}), r AS ({rng}),
b AS (SELECT u.feature, u.l_returnflag,
        CASE WHEN r.hi - r.lo > 0 THEN least(9, CAST(floor((u.value - r.lo) / (r.hi - r.lo) * 10) AS BIGINT))
             ELSE 0 END AS bin
      FROM u JOIN r ON u.feature = r.feature WHERE u.value IS NOT NULL),
j AS (SELECT feature, bin, l_returnflag, count(*) AS n_xy FROM b GROUP BY ALL),
t AS (SELECT feature,
        n_xy / sum(n_xy) OVER (PARTITION BY feature)
        * ln(n_xy * sum(n_xy) OVER (PARTITION BY feature)
             / (sum(n_xy) OVER (PARTITION BY feature, bin) * sum(n_xy) OVER (PARTITION BY feature, l_returnflag))) AS t
      FROM j)
SELECT feature, round(sum(t), 6) AS mutual_information, sum(t) > {fixed.MI_MIN} AS selected
FROM t GROUP BY feature
"""


@register("mutual_information", _mi_sql())
def mutual_information(spark, sf):
    return P.mutual_information(measures(spark, sf), PROF_COLS, "l_returnflag")


@register("interactions", f"""
WITH base AS ({MEASURES_SQL}),
u AS (UNPIVOT (SELECT {KEY}, {', '.join(PROF_COLS)} FROM base) ON {', '.join(PROF_COLS)}
      INTO NAME feature VALUE value),
p AS (SELECT feature_a, feature_b FROM ({_CORR}) WHERE abs_corr > {fixed.INTERACTION_CORR})
SELECT {', '.join('ua.' + k for k in S.LINE_KEY)}, p.feature_a, p.feature_b,
       ua.value * ub.value AS interaction, ua.value / (ub.value + {fixed.RATIO_EPS}) AS ratio
FROM p JOIN u ua ON ua.feature = p.feature_a
JOIN u ub ON ub.feature = p.feature_b AND {' AND '.join(f'ua.{k} = ub.{k}' for k in S.LINE_KEY)}
""")
def interactions(spark, sf):
    m = measures(spark, sf)
    pairs = FE.high_corr_pairs(m, PROF_COLS)
    return FE.interactions_long(m, S.LINE_KEY, pairs)


@register("polynomial", f"""
SELECT {KEY}, {', '.join(f'{c} * {c} AS {c}_squared, {c} * {c} * {c} AS {c}_cubed' for c in PROF_COLS)}
FROM ({MEASURES_SQL})
""")
def polynomial(spark, sf):
    m = measures(spark, sf).select(*S.LINE_KEY, *PROF_COLS)
    return FE.polynomial(m, PROF_COLS).drop(*PROF_COLS)


def _row_stats_sql():
    n = float(len(PROF_COLS))
    mean = f"(({' + '.join(PROF_COLS)}) / {n})"
    ss = " + ".join(f"({c} - {mean}) * ({c} - {mean})" for c in PROF_COLS)
    std = f"sqrt(({ss}) / {n})"
    return f"""
SELECT {KEY}, row_mean, row_std, row_max,
       least({', '.join(PROF_COLS)}, row_mean, row_std, row_max) AS row_min
FROM (SELECT *, greatest({', '.join(PROF_COLS)}, row_mean, row_std) AS row_max
      FROM (SELECT *, {mean} AS row_mean, {std} AS row_std FROM ({MEASURES_SQL})))
"""


@register("row_stats", _row_stats_sql())
def row_stats(spark, sf):
    m = measures(spark, sf).select(*S.LINE_KEY, *PROF_COLS)
    return FE.row_stats(m, PROF_COLS).select(*S.LINE_KEY, "row_mean", "row_std", "row_max", "row_min")


def _slog_sql():
    cols = []
    for c in SCALE_COLS:
        cols.append(f"CASE WHEN (SELECT max(abs({c})) FROM ({MEASURES_SQL})) > {fixed.EXTREME_ABS} "
                    f"THEN sign({c}) * ln(1 + abs({c})) ELSE {c} END AS {c}")
    return f"SELECT {KEY}, {', '.join(cols)} FROM ({MEASURES_SQL})"


@register("signed_log", _slog_sql())
def signed_log(spark, sf):
    m = measures(spark, sf).select(*S.LINE_KEY, *SCALE_COLS)
    return FE.signed_log_columns(m, FE.extreme_columns(m, SCALE_COLS))
