"""Label queries over orders (P12-P16, A1-A3, M1) and class weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowlens.operators import labels as L
from flowlens.plans import standins as S
from flowlens.plans.registry import register

_LABEL_SQL = """
SELECT o_orderkey, o_orderpriority AS raw_label,
       CASE WHEN contains(trim(o_orderpriority), 'NOT SPECIFIED') THEN 'Unspecified'
            WHEN trim(o_orderpriority) = '1-URGENT' THEN 'Urgent_High'
            WHEN trim(o_orderpriority) = '2-HIGH' THEN 'Urgent_High'
            ELSE trim(o_orderpriority) END AS label
FROM orders
"""
_KEPT_SQL = f"SELECT * FROM ({_LABEL_SQL}) WHERE label IS NULL OR label NOT IN ('5-LOW')"


def _regrouped(spark, sf):
    o = S.orders(spark, sf).select("o_orderkey", F.col("o_orderpriority").alias("raw_label"))
    return L.regroup_labels(o, "raw_label", out="label",
                            substring_rules=S.PRIORITY_SUBSTRING_RULES, mapping=S.PRIORITY_MAP)


def _kept(spark, sf):
    return L.exclude_classes(_regrouped(spark, sf), "label", S.PRIORITY_EXCLUDED)


@register("label_regroup", _LABEL_SQL)
def label_regroup(spark, sf):
    return _regrouped(spark, sf)


@register("class_exclude", f"SELECT o_orderkey, label FROM ({_KEPT_SQL})")
def class_exclude(spark, sf):
    return _kept(spark, sf).select("o_orderkey", "label")


@register("class_distribution", f"""
SELECT label, count(*) AS n_rows,
       round(count(*) * 100.0::DOUBLE / sum(count(*)) OVER (), 6) AS percent
FROM ({_KEPT_SQL}) GROUP BY label
""")
def class_distribution(spark, sf):
    return L.class_distribution(_kept(spark, sf), "label", min_classes=2)


@register("sorted_classes", f"""
SELECT label, CAST(row_number() OVER (ORDER BY label) - 1 AS INTEGER) AS class_index
FROM (SELECT DISTINCT label FROM ({_KEPT_SQL}) WHERE label IS NOT NULL)
""")
def sorted_classes(spark, sf):
    return L.sorted_classes(_kept(spark, sf), "label")


@register("removed_count", f"""
SELECT count(*) AS rows_before,
       count(*) FILTER (WHERE label IS NULL OR label NOT IN ('5-LOW')) AS rows_after,
       count(*) FILTER (WHERE NOT (label IS NULL OR label NOT IN ('5-LOW'))) AS rows_removed
FROM ({_LABEL_SQL})
""")
def removed_count(spark, sf):
    return L.removed_count(_regrouped(spark, sf), "label", S.PRIORITY_EXCLUDED)


@register("label_encode", f"""
SELECT o_orderkey, label,
       CAST(dense_rank() OVER (ORDER BY label) - 1 AS INTEGER) AS label_index
FROM ({_KEPT_SQL})
""")
def label_encode(spark, sf):
    return L.label_encode(_kept(spark, sf).select("o_orderkey", "label"), "label")


@register("class_weights", f"""
SELECT label, count(*) AS n_rows,
       round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS balanced_weight,
       round(sum(count(*)) OVER () / count(*), 6) AS inverse_weight
FROM ({_KEPT_SQL}) GROUP BY label
""")
def class_weights(spark, sf):
    return L.class_weights(_kept(spark, sf), "label")


@register("fixed_weights", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate, l_returnflag,
       CAST(dense_rank() OVER (ORDER BY l_returnflag) - 1 AS INTEGER) AS label_index,
       CASE dense_rank() OVER (ORDER BY l_returnflag) - 1
            WHEN 0 THEN 0.64 WHEN 1 THEN 0.18 WHEN 2 THEN 0.12 WHEN 3 THEN 0.06 END::DOUBLE AS weight
FROM lineitem
""")
def fixed_weights(spark, sf):
    li = S.lineitem(spark, sf).select(*S.LINE_KEY, "l_returnflag")
    return L.fixed_weights(L.label_encode(li, "l_returnflag"), "label_index")
