"""Scaling (A12-A13, M2-M3) and sampling / splitting (R1-R4, R6) queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import sample as R
from flowlens.operators import scale as SC
from flowlens.plans import q_labels as QL
from flowlens.plans import standins as S
from flowlens.plans.registry import register

KEY = ", ".join(S.LINE_KEY)
SCALE_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _scale_sql(center, spread):
    parts = []
    for c in SCALE_COLS:
        ctr, spr = center(c), spread(c)
        parts.append(f"({c} - {ctr}) / CASE WHEN coalesce({spr}, 0) = 0 THEN 1 ELSE {spr} END AS {c}")
    return f"SELECT {KEY}, {', '.join(parts)} FROM lineitem"


@register("standard_scale", _scale_sql(lambda c: f"avg({c}) OVER ()",
                                       lambda c: f"stddev_pop({c}) OVER ()"))
def standard_scale(spark, sf):
    li = S.lineitem(spark, sf).select(*S.LINE_KEY, *SCALE_COLS)
    return SC.standard_scale(li, SCALE_COLS)


@register("robust_scale", _scale_sql(
    lambda c: f"(SELECT quantile_cont({c}, 0.5) FROM lineitem)",
    lambda c: f"(SELECT quantile_cont({c}, 0.75) - quantile_cont({c}, 0.25) FROM lineitem)"))
def robust_scale(spark, sf):
    li = S.lineitem(spark, sf).select(*S.LINE_KEY, *SCALE_COLS)
    return SC.robust_scale(li, SCALE_COLS)


_RANKED = f"""
SELECT o_orderkey, label,
       row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn,
       count(*) OVER (PARTITION BY label) AS n
FROM ({QL._KEPT_SQL})
"""


def _kept(spark, sf):
    return QL._kept(spark, sf).select("o_orderkey", "label")


@register("stratified_split", f"""
SELECT o_orderkey, label, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split
FROM ({_RANKED})
""")
def stratified_split(spark, sf):
    return R.stratified_split(_kept(spark, sf), "label", "o_orderkey")


@register("stratified_folds", f"""
SELECT o_orderkey, label, CAST((rn - 1) % 5 AS INTEGER) AS fold FROM ({_RANKED})
""")
def stratified_folds(spark, sf):
    return R.stratified_folds(_kept(spark, sf), "label", "o_orderkey", k=5)


@register("fixed_sample", f"""
SELECT o_orderkey, label FROM ({QL._KEPT_SQL})
ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey LIMIT 100
""")
def fixed_sample(spark, sf):
    return R.fixed_sample(_kept(spark, sf), "o_orderkey", 100)


@register("rebalance_plan", f"""
SELECT label, n_rows,
       CAST(CASE WHEN n_rows < sum(n_rows) OVER () / count(*) OVER ()
                 THEN floor(sum(n_rows) OVER () / count(*) OVER ()) ELSE n_rows END AS BIGINT) AS target
FROM (SELECT label, count(*) AS n_rows FROM ({QL._KEPT_SQL}) GROUP BY label)
""")
def rebalance_plan(spark, sf):
    return R.rebalance_plan(_kept(spark, sf), "label")


@register("undersample", f"""
SELECT o_orderkey, label FROM ({_RANKED})
WHERE rn <= (SELECT min(c) FROM (SELECT count(*) AS c FROM ({QL._KEPT_SQL}) GROUP BY label))
""")
def undersample(spark, sf):
    k = _kept(spark, sf)
    return R.undersample(k, "label", "o_orderkey", R.smallest_class_plan(k, "label"))


@register("split_null_labels", """
WITH o AS (SELECT o_orderkey, nullif(o_orderpriority, '5-LOW') AS label FROM orders),
r AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5(CAST(o_orderkey AS VARCHAR)), o_orderkey) AS rn,
             count(*) OVER (PARTITION BY label) AS n FROM o)
SELECT o_orderkey, label, CASE WHEN rn <= round(n * 0.2) THEN 'test' ELSE 'train' END AS split,
       CAST((rn - 1) % 5 AS INTEGER) AS fold FROM r""")
def split_null_labels(spark, sf):
    """Rows without a label are a class of their own: split and folded, not dropped."""
    o = S.orders(spark, sf).select("o_orderkey", F.when(
        F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("label"))
    return R.stratified_folds(R.stratified_split(o, "label", "o_orderkey"), "label", "o_orderkey")
