"""Stand-ins: how the driver's tables play the roles of flow data.

The reference works on network-flow tables. The test tables are TPC-H-like, so each
query maps their columns onto flow roles. The mapping is stated once here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.sources.tables import table

# orders.o_orderpriority plays the attack label: one substring rule, one name map and one
# excluded class, with the same structure as the reference's regrouping.
PRIORITY_SUBSTRING_RULES = [("NOT SPECIFIED", "Unspecified")]
PRIORITY_MAP = {"1-URGENT": "Urgent_High", "2-HIGH": "Urgent_High"}
PRIORITY_EXCLUDED = ["5-LOW"]

# lineitem row key (unique at every scale).
LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_shipdate"]


def orders(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "orders")


def lineitem(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem")


def line_flows(spark: SparkSession, sf: str) -> DataFrame:
    """lineitem as flows (FIXTURES section 5):
    duration = l_discount (0 for zero-duration flows), fwd packets = l_quantity,
    bwd packets = l_linenumber, fwd bytes = l_extendedprice, bwd bytes = price * tax.
    """
    li = lineitem(spark, sf)
    return li.select(
        *LINE_KEY,
        F.col("l_discount").alias("flow_duration"),
        F.col("l_quantity").alias("total_fwd_packets"),
        F.col("l_linenumber").cast("double").alias("total_backward_packets"),
        F.col("l_extendedprice").alias("total_length_of_fwd_packets"),
        (F.col("l_extendedprice") * F.col("l_tax")).alias("total_length_of_bwd_packets"),
        F.col("l_tax"), F.col("l_returnflag"), F.col("l_linestatus"))


LINE_FLOWS_SQL = """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_shipdate,
       l_discount AS flow_duration, l_quantity AS total_fwd_packets,
       CAST(l_linenumber AS DOUBLE) AS total_backward_packets,
       l_extendedprice AS total_length_of_fwd_packets,
       l_extendedprice * l_tax AS total_length_of_bwd_packets,
       l_tax, l_returnflag, l_linestatus
FROM lineitem
"""
