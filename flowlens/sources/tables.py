"""Readers for the driver-provided parquet tables (one file per table)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """Parquet scan of one table; callers ``select`` what they need so Catalyst prunes."""
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")
