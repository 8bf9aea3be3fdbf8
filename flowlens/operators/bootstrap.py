"""Bagged trees with class weights balanced within each bootstrap.

A bootstrap draws each row Poisson(1) times, from a hash of (key, tree), so a draw needs no
state, is the same on every run and can be recomputed after a lost executor. The weight of a
class in a tree is n / (classes x rows of the class), all counted over that tree's draws; a
class that a bootstrap does not hold weighs nothing there. Rows without a key or label are
not drawn.

The draws of all trees are counted in one pass with partial sums; only trees x classes
weights reach the driver.
"""

from __future__ import annotations

import math
from multiprocessing.pool import ThreadPool

from pyspark.ml.classification import RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEED = 42
MAX_CLASSES = 1000
#: Chances of at most 0, 1, 2, .. draws, as far as a double tells them from 1.
LIMITS = [sum(math.exp(-1) / math.factorial(i) for i in range(j + 1)) for j in range(17)]


def drawn(key: Column, tree: Column) -> Column:
    """How often ``tree``'s bootstrap holds the row: Poisson(1) from the md5 of key and tree."""
    digits = F.substring(F.md5(F.concat(key.cast("string"), F.lit(":"), tree.cast("string"))), 1, 13)
    u = F.conv(digits, 16, 10).cast("long") / F.lit(float(1 << 52))
    return sum(((u >= limit).cast("int") for limit in LIMITS), F.lit(0))


def class_weights(df: DataFrame, key: str, label: str, trees: int) -> DataFrame:
    """(tree, label, n_rows, weight) of every class that a tree's bootstrap holds."""
    rows = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(
        key, label, F.explode(F.sequence(F.lit(0), F.lit(trees - 1))).alias("tree"))
    counts = rows.groupBy("tree", label).agg(
        F.sum(drawn(F.col(key), F.col("tree"))).cast("long").alias("n_rows")).where("n_rows > 0")
    of_tree = Window.partitionBy("tree")      # one row per class
    return counts.withColumn("weight", F.sum("n_rows").over(of_tree)
                             / (F.count(F.lit(1)).over(of_tree) * F.col("n_rows")))


def fit(df: DataFrame, key: str, label: str, trees: int = 100, max_depth: int = 30, min_leaf: int = 1,
        feature_subset: str = "sqrt", parallel: int = 4) -> list[RandomForestClassificationModel]:
    """One tree per bootstrap over ``features`` and class numbers ``label`` (0, 1, ..), each with
    its own draws and class weights; ``parallel`` trees are fitted at a time."""
    df = df.where(F.col(key).isNotNull() & F.col(label).isNotNull()).select(key, label, "features").persist()
    try:
        classes = sorted(r[0] for r in df.select(label).distinct().limit(MAX_CLASSES + 1).collect())
        if len(classes) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} classes")
        if not classes:
            raise ValueError("no labelled rows")
        weights: dict[int, dict] = {}
        for r in class_weights(df, key, label, trees).collect():
            weights.setdefault(r["tree"], {})[r[label]] = r["weight"]
        # a bootstrap may miss a class: all trees answer for all classes
        known = {"ml_attr": {"type": "nominal", "vals": [str(i) for i in range(int(classes[-1]) + 1)]}}

        def one(tree: int) -> RandomForestClassificationModel:
            of_class = F.create_map(*[F.lit(x) for pair in weights[tree].items() for x in pair])
            rows = df.withColumn("__drawn", drawn(F.col(key), F.lit(tree))).where("__drawn > 0").select(
                "features", F.col(label).cast("double").alias(label, metadata=known),
                (F.col("__drawn") * F.element_at(of_class, F.col(label))).alias("__weight"))
            grown = RandomForestClassifier(
                numTrees=1, bootstrap=False, maxDepth=max_depth, minInstancesPerNode=min_leaf,
                featureSubsetStrategy=feature_subset, labelCol=label, featuresCol="features",
                weightCol="__weight", seed=SEED + tree)
            return grown.fit(rows)

        with ThreadPool(parallel) as pool:
            return pool.map(one, sorted(weights), chunksize=1)
    finally:
        df.unpersist()


def predict(models: list[RandomForestClassificationModel], df: DataFrame) -> DataFrame:
    """Adds ``probability`` (mean over the trees) and ``prediction`` (first largest class)."""
    out, total = df, None
    for i, model in enumerate(models):
        one = model.copy().setPredictionCol("").setRawPredictionCol("").setProbabilityCol(f"__q{i}")
        out = one.transform(out)
        p = vector_to_array(F.col(f"__q{i}"))
        total = p if total is None else F.zip_with(total, p, lambda a, b: a + b)
    out = out.withColumn("probability", F.transform(total, lambda v: v / len(models)))
    best = F.array_position("probability", F.array_max("probability")) - 1
    return out.withColumn("prediction", best.cast("double")).drop(*[f"__q{i}" for i in range(len(models))])
