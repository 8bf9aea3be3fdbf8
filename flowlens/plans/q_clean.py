"""Cleaning and projection queries over lineitem-as-flows."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.functions import scalar as X
from flowlens.operators import clean as C
from flowlens.plans import standins as S
from flowlens.plans.registry import register
from flowlens.sources.schema import align_names

KEY = ", ".join(S.LINE_KEY)


def sql_ieee(num: str, den: str) -> str:
    """SQL twin of ``scalar.ieee_divide``."""
    return (f"CASE WHEN ({den}) <> 0 THEN ({num}) / ({den}) "
            f"WHEN ({num}) IS NULL OR ({den}) IS NULL THEN NULL "
            f"WHEN ({num}) = 0 OR isnan({num}) THEN 'NaN'::DOUBLE "
            f"WHEN ({num}) > 0 THEN 'Infinity'::DOUBLE ELSE '-Infinity'::DOUBLE END")


def dirty_flows(spark, sf):
    """Flows with the reference's raw (unguarded) rates: Inf on zero duration, NaN on 0/0,
    -1 window sizes and a NaN attack probability."""
    li = S.lineitem(spark, sf)
    return li.select(
        *S.LINE_KEY,
        F.col("l_discount").alias("flow_duration"),
        F.col("l_quantity").alias("total_fwd_packets"),
        X.ieee_divide(F.col("l_extendedprice") * (1 + F.col("l_tax")), F.col("l_discount"))
        .alias("flow_bytes_per_s"),
        X.ieee_divide(F.col("l_quantity") * F.col("l_tax"), F.col("l_discount"))
        .alias("flow_packets_per_s"),
        X.ieee_divide(F.col("l_quantity"), F.col("l_tax")).alias("fwd_packets_per_s"),
        (F.col("l_linenumber") - 2).cast("double").alias("init_win_bytes_forward"),
        (F.col("l_quantity") - 2).alias("init_win_bytes_backward"),
        X.ieee_divide(F.col("l_tax"), F.col("l_tax") + F.col("l_discount")).alias("attack_prob"))


DIRTY_SQL = f"""
SELECT {KEY}, l_discount AS flow_duration, l_quantity AS total_fwd_packets,
  {sql_ieee('l_extendedprice * (1 + l_tax)', 'l_discount')} AS flow_bytes_per_s,
  {sql_ieee('l_quantity * l_tax', 'l_discount')} AS flow_packets_per_s,
  {sql_ieee('l_quantity', 'l_tax')} AS fwd_packets_per_s,
  CAST(l_linenumber - 2 AS DOUBLE) AS init_win_bytes_forward,
  l_quantity - 2 AS init_win_bytes_backward,
  {sql_ieee('l_tax', 'l_tax + l_discount')} AS attack_prob
FROM lineitem
"""
RATE_COLS = ["flow_bytes_per_s", "flow_packets_per_s", "fwd_packets_per_s", "attack_prob"]


def _sql_clean(c):
    return f"CASE WHEN {c} IS NULL OR isnan({c}) OR isinf({c}) THEN 0.0 ELSE {c} END AS {c}"


@register("clean_fill", f"""
SELECT {KEY}, flow_duration, total_fwd_packets, {', '.join(_sql_clean(c) for c in RATE_COLS)}
FROM ({DIRTY_SQL})
""")
def clean_fill(spark, sf):
    d = dirty_flows(spark, sf).drop("init_win_bytes_forward", "init_win_bytes_backward")
    return C.clean_fill(d, RATE_COLS)


@register("clean_drop", f"""
SELECT {KEY}, flow_duration, total_fwd_packets, {', '.join(RATE_COLS)} FROM ({DIRTY_SQL})
WHERE {' AND '.join(f'isfinite({c})' for c in RATE_COLS)}
""")
def clean_drop(spark, sf):
    d = dirty_flows(spark, sf).drop("init_win_bytes_forward", "init_win_bytes_backward")
    return C.clean_drop(d, RATE_COLS)


@register("sentinel_replace", f"""
SELECT {KEY},
  CASE WHEN init_win_bytes_forward = -1 THEN 0.0 ELSE init_win_bytes_forward END AS init_win_bytes_forward,
  CASE WHEN init_win_bytes_backward = -1 THEN 0.0 ELSE init_win_bytes_backward END AS init_win_bytes_backward
FROM ({DIRTY_SQL})
""")
def sentinel_replace(spark, sf):
    d = dirty_flows(spark, sf).select(*S.LINE_KEY, "init_win_bytes_forward", "init_win_bytes_backward")
    return C.replace_sentinel(d, ["init_win_bytes_forward", "init_win_bytes_backward"])


@register("nan_prob", f"""
SELECT {KEY},
  CASE WHEN attack_prob IS NULL OR isnan(attack_prob) THEN 0.0 ELSE attack_prob END AS attack_prob,
  CASE WHEN (1 - attack_prob) IS NULL OR isnan(1 - attack_prob) THEN 0.0 ELSE 1 - attack_prob END AS benign_prob
FROM ({DIRTY_SQL})
""")
def nan_prob(spark, sf):
    d = dirty_flows(spark, sf)
    return d.select(*S.LINE_KEY, C.nan_to_zero(F.col("attack_prob")).alias("attack_prob"),
                    C.nan_to_zero(1 - F.col("attack_prob")).alias("benign_prob"))


@register("flow_rates", f"""
SELECT {KEY},
  CASE WHEN flow_duration = 0 THEN 0.0
       ELSE (total_length_of_fwd_packets + total_length_of_bwd_packets) / flow_duration END AS flow_bytes_per_s,
  CASE WHEN flow_duration = 0 THEN 0.0
       ELSE (total_fwd_packets + total_backward_packets) / flow_duration END AS flow_packets_per_s
FROM ({S.LINE_FLOWS_SQL})
""")
def flow_rates(spark, sf):
    f = S.line_flows(spark, sf)
    return C.flow_rates(f, "flow_duration", "total_length_of_fwd_packets",
                        "total_length_of_bwd_packets", "total_fwd_packets",
                        "total_backward_packets").select(
        *S.LINE_KEY, "flow_bytes_per_s", "flow_packets_per_s")


@register("clamp_non_negative", f"""
SELECT {KEY},
  greatest(0, CAST(trunc(l_quantity - 25.5) AS BIGINT)) AS fwd_packets_delta,
  greatest(0, CAST(trunc(CAST(l_linenumber AS DOUBLE) - 3.5) AS BIGINT)) AS bwd_packets_delta,
  greatest(0.0, l_tax - 0.04) AS tax_excess
FROM lineitem
""")
def clamp_non_negative(spark, sf):
    li = S.lineitem(spark, sf).select(
        *S.LINE_KEY, (F.col("l_quantity") - 25.5).alias("fwd_packets_delta"),
        (F.col("l_linenumber").cast("double") - 3.5).alias("bwd_packets_delta"),
        (F.col("l_tax") - 0.04).alias("tax_excess"))
    return C.clamp_non_negative(li, count_cols=["fwd_packets_delta", "bwd_packets_delta"],
                                real_cols=["tax_excess"])


# Columns named after flow features, NULL where l_tax = 0; each gets its rule default.
_FILL_SOURCES = [
    ("flow_duration", "Flow Duration", "l_discount"),
    ("total_length_of_fwd_packets", "Total Length of Fwd Packets", "l_extendedprice"),
    ("flow_packets_per_s", "Flow Packets/s", "l_quantity"),
    ("syn_flag_count", "SYN Flag Count", "l_linenumber"),
    ("flow_iat_mean", "Flow IAT Mean", "l_tax"),
    ("fwd_packet_length_max", "Fwd Packet Length Max", "l_quantity"),
    ("min_packet_length", "Min Packet Length", "l_discount"),
    ("fwd_packets_per_s", "Fwd Packets/s", "l_quantity"),
    ("destination_port", "Destination Port", "l_suppkey"),
    ("down_up_ratio", "Down/Up Ratio", "l_tax"),
]


def _fill_sql():
    defaults = C.benign_defaults()
    parts = []
    for col, name, src in _FILL_SOURCES:
        d = C.default_for_name(name, defaults)
        parts.append(f"coalesce(CASE WHEN l_tax = 0 THEN NULL ELSE CAST({src} AS DOUBLE) END, "
                     f"{d!r}::DOUBLE) AS {col}")
    return f"SELECT {KEY}, {', '.join(parts)} FROM lineitem"


@register("fill_by_name_rule", _fill_sql())
def fill_by_name_rule(spark, sf):
    li = S.lineitem(spark, sf)
    holes = li.select(*S.LINE_KEY, *[
        F.when(F.col("l_tax") == 0, F.lit(None)).otherwise(F.col(src).cast("double")).alias(col)
        for col, _, src in _FILL_SOURCES])
    return C.fill_by_name_rule(holes, {col: name for col, name, _ in _FILL_SOURCES},
                               C.benign_defaults())


# Source columns spelled differently from the contract; one contract column is absent.
_ALIGN_EXPECTED = ["Destination Port", "Flow Duration", "Total Fwd Packets",
                   "Total Backward Packets", "Total Length of Fwd Packets"]


@register("align_names", f"""
SELECT {KEY}, 0.0::DOUBLE AS destination_port, l_discount AS flow_duration,
  l_quantity AS total_fwd_packets, CAST(l_linenumber AS DOUBLE) AS total_backward_packets,
  l_extendedprice AS total_length_of_fwd_packets
FROM lineitem
""")
def align_names_q(spark, sf):
    li = S.lineitem(spark, sf)
    messy = li.select(*S.LINE_KEY, F.col("l_discount").alias("FLOW_DURATION"),
                      F.col("l_quantity").alias("total fwd packets"),
                      F.col("l_linenumber").alias("TotalBackwardPackets"),
                      F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
                      F.col("l_tax").alias("Extra Column"))
    return align_names(messy, _ALIGN_EXPECTED, keys=S.LINE_KEY)


@register("drop_and_order", f"""
SELECT {KEY}, flow_duration, total_fwd_packets, total_backward_packets,
  total_length_of_fwd_packets, total_length_of_bwd_packets
FROM ({S.LINE_FLOWS_SQL})
""")
def drop_and_order(spark, sf):
    from flowlens.sources.schema import FLOW_COLUMNS
    f = S.line_flows(spark, sf).withColumnRenamed("l_returnflag", "label") \
        .withColumnRenamed("l_linestatus", "attack_type")
    f = C.drop_if_present(f, ["label", "attack_type", "not_there"])
    feats = [c for c in FLOW_COLUMNS if c in f.columns]
    return f.select(*S.LINE_KEY, *feats)


_UNPIVOT_COLS = ["flow_duration", "total_fwd_packets", "total_backward_packets",
                 "total_length_of_fwd_packets", "total_length_of_bwd_packets"]


@register("unpivot_row", f"""
SELECT {KEY}, feature, value FROM (
  UNPIVOT ({S.LINE_FLOWS_SQL}) ON {', '.join(_UNPIVOT_COLS)} INTO NAME feature VALUE value)
""")
def unpivot_row(spark, sf):
    f = S.line_flows(spark, sf)
    return C.unpivot_long(f, S.LINE_KEY, _UNPIVOT_COLS)


def _scored(f, model, cut):
    p = F.col("l_quantity") / 50.0
    return {f"{model}_Prediction": X.prediction_text(p >= cut), f"{model}_AttackProb": p}


@register("pad_results", """
WITH a AS (
  SELECT CAST(l_orderkey AS VARCHAR) AS l_orderkey, CAST(l_partkey AS VARCHAR) AS l_partkey,
         CAST(l_suppkey AS VARCHAR) AS l_suppkey, CAST(l_linenumber AS VARCHAR) AS l_linenumber,
         CAST(l_discount AS VARCHAR) AS flow_duration, CAST(l_quantity AS VARCHAR) AS total_fwd_packets,
         CASE WHEN l_quantity / 50.0 >= 0.5 THEN 'Attack' ELSE 'Benign' END AS "GBM_Prediction",
         CAST(l_quantity / 50.0 AS VARCHAR) AS "GBM_AttackProb",
         CASE WHEN l_quantity / 50.0 >= 0.3 THEN 'Attack' ELSE 'Benign' END AS "XGBoost_Prediction",
         CAST(l_quantity / 50.0 AS VARCHAR) AS "XGBoost_AttackProb",
         'N/A' AS "CatBoost_Prediction", 'N/A' AS "CatBoost_AttackProb"
  FROM lineitem WHERE l_returnflag = 'A'),
b AS (
  SELECT CAST(l_orderkey AS VARCHAR), CAST(l_partkey AS VARCHAR), CAST(l_suppkey AS VARCHAR),
         CAST(l_linenumber AS VARCHAR), CAST(l_discount AS VARCHAR), 'N/A',
         'N/A', 'N/A',
         CASE WHEN l_quantity / 50.0 >= 0.3 THEN 'Attack' ELSE 'Benign' END,
         CAST(l_quantity / 50.0 AS VARCHAR),
         CASE WHEN l_quantity / 50.0 >= 0.7 THEN 'Attack' ELSE 'Benign' END,
         CAST(l_quantity / 50.0 AS VARCHAR)
  FROM lineitem WHERE l_returnflag <> 'A')
SELECT * FROM a UNION ALL SELECT * FROM b
""")
def pad_results(spark, sf):
    li = S.lineitem(spark, sf)
    keys = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
    a = li.where(F.col("l_returnflag") == "A").select(
        *keys, F.col("l_discount").alias("flow_duration"),
        F.col("l_quantity").alias("total_fwd_packets"), "l_quantity")
    a = a.withColumns({**_scored(a, "GBM", 0.5), **_scored(a, "XGBoost", 0.3)}).drop("l_quantity")
    b = li.where(F.col("l_returnflag") != "A").select(
        *keys, F.col("l_discount").alias("flow_duration"), "l_quantity")
    b = b.withColumns({**_scored(b, "XGBoost", 0.3), **_scored(b, "CatBoost", 0.7)}).drop("l_quantity")
    model_cols = [f"{m}_{s}" for m in ("GBM", "XGBoost", "CatBoost") for s in ("Prediction", "AttackProb")]
    return C.pad_results([a, b], ["flow_duration", "total_fwd_packets"], model_cols)


_VALUE_COLS = ["flow_duration", "total_fwd_packets", "total_backward_packets",
               "total_length_of_fwd_packets"]


@register("feature_values", f"""
SELECT {KEY}, feature, printf('%.2f', value) AS value_text FROM (
  UNPIVOT ({S.LINE_FLOWS_SQL}) ON {', '.join(_VALUE_COLS)} INTO NAME feature VALUE value)
""")
def feature_values(spark, sf):
    """P18 + F6: each flow as (feature, value) rows with the value as 2-decimal text."""
    f = S.line_flows(spark, sf)
    return C.unpivot_long(f, S.LINE_KEY, _VALUE_COLS).select(
        *S.LINE_KEY, "feature", X.fmt2(F.col("value")).alias("value_text"))


@register("feature_values_typed", f"""
SELECT {KEY}, 'supplier' AS feature, CAST(l_suppkey AS VARCHAR) AS value_text FROM lineitem
UNION ALL SELECT {KEY}, 'flag', l_returnflag FROM lineitem
UNION ALL SELECT {KEY}, 'discount', printf('%.2f', l_discount) FROM lineitem
""")
def feature_values_typed(spark, sf):
    """P18 + F6: integers and texts as they are, floats with 2 decimals."""
    li = S.lineitem(spark, sf).select(*S.LINE_KEY, F.col("l_suppkey").alias("supplier"),
                                      F.col("l_returnflag").alias("flag"), F.col("l_discount").alias("discount"))
    return C.unpivot_text(li, S.LINE_KEY, ["supplier", "flag", "discount"])
