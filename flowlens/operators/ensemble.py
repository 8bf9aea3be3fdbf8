"""Tree ensembles with Spark ML.

Spark ML trains and scores in parallel over partitions; the driver only holds models
and a few metric rows. Multiclass boosting is ``OneVsRest(GBTClassifier)`` (Spark's GBT
is binary); its class probabilities come from each binary model's probability of 1,
normalised over classes.
"""

from __future__ import annotations

import random
from collections.abc import Sequence

from pyspark.ml import Model
from pyspark.ml.classification import (GBTClassifier, OneVsRest, OneVsRestModel,
                                       RandomForestClassifier)
from pyspark.ml.evaluation import MulticlassClassificationEvaluator
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.tuning import CrossValidator, ParamGridBuilder
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators import forest as grown
from flowlens.operators.joins import join_groups

SEED = 42


def feature_names(n: int, prefix: str = "e") -> list[str]:
    return [f"{prefix}{i}" for i in range(n)]


def with_features(df: DataFrame, array_col: str, out: str = "features") -> DataFrame:
    """array<float> -> ml Vector (JVM-side, no Python)."""
    return df.withColumn(out, array_to_vector(F.col(array_col).cast("array<double>")))


def with_balanced_weight(df: DataFrame, label: str, out: str = "weight") -> DataFrame:
    """A15 as a weight column: n / (k * class count), joined back from a class table."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("__c"))
    w = Window.partitionBy()
    counts = counts.select(label, (F.sum("__c").over(w) / (F.count(F.lit(1)).over(w) * F.col("__c")))
                           .alias(out))
    return join_groups(df, counts, on=label)


# ---- estimators (reference settings as defaults; queries pass smaller ones) ----------
def forest(num_trees: int = 100, max_depth: int = 30, min_leaf: int = 1,
           feature_subset: str = "sqrt", weight_col: str | None = None, label: str = "label",
           seed: int = SEED) -> RandomForestClassifier:
    """M4: random forest (unlimited depth in the reference -> Spark's maximum 30)."""
    rf = RandomForestClassifier(numTrees=num_trees, maxDepth=max_depth,
                                minInstancesPerNode=min_leaf, featureSubsetStrategy=feature_subset,
                                labelCol=label, featuresCol="features", seed=seed)
    if weight_col:
        rf.setWeightCol(weight_col)
    return rf


def fit_persisted(estimator, df: DataFrame):
    """Fit on a persisted copy of ``df``: tree learners scan their input several times
    before the first level (metadata, split candidates, binning), and each scan would
    otherwise recompute the input's lineage (joins, windows). Lost blocks are recomputed
    from lineage, so executor loss stays safe."""
    data = df.persist()
    try:
        return estimator.fit(data)
    finally:
        data.unpersist()


BOOST_CONFIGS = {
    # M5 gradient boosting: 500 x .05, depth 6, subsample .8, leaf 20, sqrt features
    "gbm": dict(maxIter=500, stepSize=0.05, maxDepth=6, subsamplingRate=0.8,
                minInstancesPerNode=20, featureSubsetStrategy="sqrt"),
    # M6 leaf-wise boosting stand-in: 3000 x .01, depth 15, class weights
    "lgbm": dict(maxIter=3000, stepSize=0.01, maxDepth=15),
    # M7 regularised boosting stand-in: depth / rate / trees from the grid, subsample .8
    "xgb": dict(maxIter=500, stepSize=0.1, maxDepth=6, subsamplingRate=0.8,
                featureSubsetStrategy="0.8", minInstancesPerNode=1, minInfoGain=0.1),
    # M8 ordered boosting stand-in: 1000 x .05, depth 8
    "cat": dict(maxIter=1000, stepSize=0.05, maxDepth=8),
}


def boosted(kind: str, label: str = "label", weight_col: str | None = None,
            validation_col: str | None = None, parallelism: int = 4, **overrides) -> OneVsRest:
    """M5-M8: one-vs-rest gradient-boosted trees with the named configuration."""
    params = {**BOOST_CONFIGS[kind], **overrides}
    gbt = GBTClassifier(featuresCol="features", seed=SEED, **params)
    if validation_col:
        gbt.setValidationIndicatorCol(validation_col)
    ovr = OneVsRest(classifier=gbt, labelCol=label, featuresCol="features",
                    parallelism=parallelism)
    if weight_col:
        ovr.setWeightCol(weight_col)
    return ovr


def fit_boosted(df: DataFrame, kind: str, label: str = "label", weight_col: str | None = None,
                validation_col: str | None = None, validation_tol: float = 0.01,
                parallelism: int = 4, max_classes: int = 1000, **overrides) -> OneVsRestModel:
    """M5/M6/M8 with early stopping on a separate validation set.

    Spark's OneVsRest keeps only label / features / weight, so the validation indicator
    would be lost; this fits the per-class binary GBTs itself (in ``parallelism``
    threads, as OneVsRest does) on one persisted input, and wraps them in a
    ``OneVsRestModel``. Labels must be 0 .. k-1."""
    if validation_col is None:
        return boosted(kind, label=label, weight_col=weight_col, parallelism=parallelism,
                       **overrides).fit(df)
    from concurrent.futures import ThreadPoolExecutor
    params = {**BOOST_CONFIGS[kind], **overrides}
    cols = [label, "features", validation_col] + ([weight_col] if weight_col else [])
    data = df.select(*cols).persist()
    try:
        k = int(data.agg(F.max(label)).first()[0]) + 1
        if k > max_classes:
            raise ValueError("too many classes")

        def fit_one(i: int):
            gbt = GBTClassifier(featuresCol="features", labelCol="__bin", seed=SEED,
                                validationIndicatorCol=validation_col,
                                validationTol=validation_tol, **params)
            if weight_col:
                gbt.setWeightCol(weight_col)
            return gbt.fit(data.withColumn("__bin", (F.col(label) == float(i)).cast("double")))

        with ThreadPoolExecutor(max_workers=max(1, parallelism)) as pool:
            models = list(pool.map(fit_one, range(k)))
    finally:
        data.unpersist()
    ovr = OneVsRestModel(models)
    ovr._set(labelCol=label, featuresCol="features")
    return ovr


def best_iterations(model: OneVsRestModel, validation: DataFrame, label: str = "label"):
    """M8 best round: per class, trees built and the iteration with the lowest
    validation loss (``evaluateEachIteration``)."""
    out = []
    for i, m in enumerate(model.models):
        v = validation.withColumn("__bin", (F.col(label) == float(i)).cast("double"))
        losses = m.copy().setLabelCol("__bin").evaluateEachIteration(v) \
            if hasattr(m, "setLabelCol") else m.evaluateEachIteration(v)
        best = min(range(len(losses)), key=lambda j: losses[j])
        out.append((i, m.getNumTrees, best + 1, float(losses[best])))
    return out


# ---- scoring ---------------------------------------------------------------------------
def predict(model: Model, df: DataFrame, prob_col: str = "probability") -> DataFrame:
    """Prediction and class-probability array per row (OvR: per-class probability of
    1 from each binary model, normalised)."""
    if isinstance(model, OneVsRestModel):
        out = df
        cols = []
        for i, m in enumerate(model.models):
            m = m.copy()
            m.setPredictionCol(f"__p{i}").setRawPredictionCol(f"__r{i}").setProbabilityCol(f"__q{i}")
            out = m.transform(out)
            cols.append(vector_to_array(F.col(f"__q{i}"))[1])
        tot = cols[0]
        for c in cols[1:]:
            tot = tot + c
        probs = F.array(*[F.try_divide(c, tot) for c in cols])
        out = out.withColumn(prob_col, probs).drop(
            *[x for i in range(len(model.models)) for x in (f"__p{i}", f"__r{i}", f"__q{i}")])
        best = F.array_position(F.col(prob_col), F.array_max(F.col(prob_col))) - 1
        return out.withColumn("prediction", best.cast("double"))
    out = model.transform(df)
    return out.withColumn(prob_col, vector_to_array(F.col("probability"))).drop("rawPrediction")


def importances(model: Model, names: Sequence[str], model_name: str) -> list[tuple[str, str, float]]:
    """Feature importances (trees), else |coefficients| (linear), else zeros; zeros
    when the length does not match the names. OvR: mean over the binary models."""
    vec = None
    if isinstance(model, OneVsRestModel):
        acc = None
        for m in model.models:
            v = m.featureImportances.toArray()
            acc = v if acc is None else acc + v
        vec = acc / len(model.models) if acc is not None else None
    elif hasattr(model, "importance"):         # softmax boosting, forests grown by ``forest``
        vec = model.importance
    elif hasattr(model, "featureImportances"):
        vec = model.featureImportances.toArray()
    elif hasattr(model, "coefficients"):
        vec = abs(model.coefficients.toArray())
    if vec is None or len(vec) != len(names):
        return [(model_name, n, 0.0) for n in names]
    return [(model_name, n, float(v)) for n, v in zip(names, vec)]


def importance_frame(spark, rows: list[tuple[str, str, float]]) -> DataFrame:
    return spark.createDataFrame(rows, "model string, feature string, importance double")


# ---- evaluation and tuning -------------------------------------------------------------
def weighted_f1(label: str = "label") -> MulticlassClassificationEvaluator:
    return MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                             metricName="f1")


def fold_metrics(scored: DataFrame, label: str = "label") -> dict[str, float]:
    """A21/A22 on a scored frame via Spark's evaluator (weighted metrics)."""
    out = {}
    for name, metric in [("accuracy", "accuracy"), ("f1_score", "f1"),
                         ("precision", "weightedPrecision"), ("recall", "weightedRecall")]:
        ev = MulticlassClassificationEvaluator(labelCol=label, predictionCol="prediction",
                                               metricName=metric)
        out[name] = float(ev.evaluate(scored))
    return out


def kfold_scores(df: DataFrame, estimator, fold_col: str, k: int,
                 label: str = "label") -> list[dict]:
    """Fit on k-1 folds, score the held-out fold; the 4 metrics per fold.
    The input is persisted for the k fits and released afterwards."""
    df = df.persist()
    try:
        rows = []
        for f in range(k):
            train = df.where(F.col(fold_col) != f)
            test = df.where(F.col(fold_col) == f)
            model = estimator.fit(train)
            m = fold_metrics(predict(model, test), label)
            rows.append({"fold": f, **m})
        return rows
    finally:
        df.unpersist()


def sampled_grid(grid: dict[str, list], draws: int, seed: int = SEED) -> list[dict]:
    """M9: ``draws`` distinct cells of the full grid, sampled with a fixed seed."""
    keys = list(grid)
    cells = [[]]
    for k in keys:
        cells = [c + [v] for c in cells for v in grid[k]]
    rnd = random.Random(seed)
    picked = rnd.sample(cells, min(draws, len(cells)))
    return [dict(zip(keys, c)) for c in picked]


def search(df: DataFrame, estimator, param_cells: list[dict], fold_col: str, num_folds: int,
           label: str = "label", parallelism: int = 2):
    """Cross-validated search over explicit parameter cells, scored by weighted
    F1, with deterministic folds from ``fold_col``. Cells of a one-vs-rest estimator name
    parameters of its classifier. Returns (cv model, [(cell, score)]); forests that are grown in parallel
    share their jobs and return no model."""
    if isinstance(estimator, grown.Estimator):
        return None, estimator.search(df, param_cells, fold_col, num_folds)
    owner = estimator.getClassifier() if isinstance(estimator, OneVsRest) else estimator
    builder = ParamGridBuilder()
    maps = []
    for cell in param_cells:
        pm = {}
        for name, value in cell.items():
            pm[owner.getParam(name)] = value
        maps.append(pm)
    cv = CrossValidator(estimator=estimator, estimatorParamMaps=maps or builder.build(),
                        evaluator=weighted_f1(label), foldCol=fold_col, numFolds=num_folds,
                        parallelism=parallelism,
                        seed=SEED)
    df = df.persist()
    try:
        model = cv.fit(df)
    finally:
        df.unpersist()
    return model, list(zip(param_cells, model.avgMetrics))
