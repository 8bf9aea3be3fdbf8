"""Deterministic sampling, splitting and rebalancing.

Order within a class is md5(key as text) then key, so results are reproducible and equal
to the SQL twin. Ranks come from ``windows.hash_rank``: exact, and a class holding a third
of all rows is spread over thousands of hash buckets instead of one window task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.joins import join_groups
from flowlens.operators.windows import hash_rank


def stratified_split(df: DataFrame, label: str, key: str, test_fraction: float = 0.2,
                     out: str = "split") -> DataFrame:
    """Per class, the first round(fraction * class size) rows by hash order are 'test'."""
    r = hash_rank(df, [label], key, rank="__r", total="__class_n")
    is_test = F.col("__r") <= F.round(F.col("__class_n") * test_fraction)
    return r.withColumn(out, F.when(is_test, F.lit("test")).otherwise(F.lit("train"))).drop(
        "__r", "__class_n", "__h")


def stratified_folds(df: DataFrame, label: str, key: str, k: int = 5, out: str = "fold") -> DataFrame:
    """R2: fold = (rank - 1) mod k within each class; folds partition the rows."""
    r = hash_rank(df, [label], key, rank="__r")
    return r.withColumn(out, ((F.col("__r") - 1) % k).cast("int")).drop("__r", "__h")


def fixed_sample(df: DataFrame, key: str, n: int) -> DataFrame:
    """min(n, rows) rows, first by (md5(key), key); a distributed top-n (each task
    keeps n candidates, the driver merges n * tasks rows)."""
    h = F.md5(F.col(key).cast("string"))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def rebalance_plan(df: DataFrame, label: str) -> DataFrame:
    """Per class target = int(n / k) when the class is below n / k, else unchanged."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    w = Window.partitionBy()
    fair = F.sum("n_rows").over(w) / F.count(F.lit(1)).over(w)
    return counts.select(label, "n_rows", F.when(F.col("n_rows") < fair, F.floor(fair))
                         .otherwise(F.col("n_rows")).cast("long").alias("target"))


def undersample(df: DataFrame, label: str, key: str, plan: DataFrame,
                target: str = "target") -> DataFrame:
    """Keep the first ``target`` rows of each class in hash order."""
    r = hash_rank(df, [label], key, rank="__r")
    j = join_groups(r, plan.select(label, target), on=label)
    return j.where(F.col("__r") <= F.col(target)).drop("__r", "__h", target)


def smallest_class_plan(df: DataFrame, label: str) -> DataFrame:
    """Plan that brings every class down to the smallest class size."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n_rows"))
    return counts.select(label, "n_rows",
                         F.min("n_rows").over(Window.partitionBy()).alias("target"))


def split_frames(df: DataFrame, col: str = "split") -> tuple[DataFrame, DataFrame]:
    """(train, test) views of a split table."""
    return df.where(F.col(col) == "train"), df.where(F.col(col) == "test")


def learning_fractions(points: int = 5, lo: float = 0.1, hi: float = 1.0) -> list[float]:
    """linspace(lo, hi, points)."""
    if points == 1:
        return [hi]
    return [lo + (hi - lo) * i / (points - 1) for i in range(points)]


def prefix_fraction(df: DataFrame, label: str, key: str, fraction: float,
                    ranked: Sequence[str] | None = None) -> DataFrame:
    """The first ``fraction`` of each class in hash order (nested: a smaller fraction
    is a subset of a larger one)."""
    r = hash_rank(df, [label], key, rank="__r", total="__class_n")
    return r.where(F.col("__r") <= F.ceil(F.col("__class_n") * fraction)).drop(
        "__r", "__h", "__class_n")
