"""Learning, scoring and explanation queries on ``embeddings`` (rows-only checks).

Feature matrix: the 64-float embedding (features e0..e63), label 0..9. Split / folds come
from the deterministic stratified operators. All ten classes are fitted with the reference's
settings (the operators' defaults, ``B.CONFIGS``, ``B.GRID``, ``RF_SPACE``); forests, boosted models and searches learn
from all labelled rows.
"""

from __future__ import annotations

import time

from pyspark.sql import functions as F

from flowlens.operators import boosting as B
from flowlens.operators import bootstrap as BS
from flowlens.operators import ensemble as M
from flowlens.operators import explain as X
from flowlens.operators import forest as FO
from flowlens.operators import profile as P
from flowlens.operators import sample as R
from flowlens.operators import smote as SM
from flowlens.operators import treeshap as T
from flowlens.operators import evaluate as E
from flowlens.operators.windows import hash_rank
from flowlens.plans.registry import register
from flowlens.session import cut_lineage
from flowlens.sources.tables import table

NAMES = M.feature_names(64)
_CACHE: dict = {}

def emb(spark, sf):
    e = table(spark, sf, "embeddings").select(
        "vec_id", F.col("label").cast("double").alias("label"), "embedding")
    return M.with_features(e, "embedding")


def spread(spark, df):
    """Rows over all cores: a small file is one partition, and explaining a row takes far longer
    than moving it."""
    return df.repartition(max(spark.sparkContext.defaultParallelism,
                              int(spark.conf.get("spark.sql.shuffle.partitions"))), "vec_id")


def _cached(spark, key, fn):
    k = (spark.sparkContext.applicationId, *key)
    if k not in _CACHE:
        _CACHE[k] = fn()
    return _CACHE[k]


def split(spark, sf):
    """Written once for the fits and the scores of a query: ranks within classes take several shuffles."""
    return _cached(spark, ("split", sf), lambda: cut_lineage(R.stratified_split(emb(spark, sf).drop("features"), "label", "vec_id")))


def trained_forest(spark, sf):
    def fit():
        s = split(spark, sf)
        train = M.with_balanced_weight(s.where(F.col("split") == "train"), "label")
        t0 = time.perf_counter()
        model = M.fit_persisted(FO.Estimator("vec_id", "embedding", weight_col="weight"), train.drop("features"))
        return model, time.perf_counter() - t0
    return _cached(spark, ("forest", sf), fit)


def train_validation(spark, sf):
    """Training rows of the split with a 15 % stratified validation flag (D11: early
    stopping never looks at the test rows)."""
    s = split(spark, sf)
    train = s.where(F.col("split") == "train").drop("split")
    v = R.stratified_split(train, "label", "vec_id", test_fraction=0.15, out="part")
    return v.withColumn("is_validation", F.col("part") == "test").drop("part")


def tuned(spark, sf):
    """(settings, scores): the grid's best cell by 2-fold weighted F1, and every cell's mean."""
    def run():
        scores = B.search(_folds(spark, sf, 2), B.CONFIGS["xgb"], B.GRID, "label", "vec_id", "embedding", "fold", 2)
        return B.best_settings(scores, B.CONFIGS["xgb"], B.GRID)
    return _cached(spark, ("grid", sf), run)


def trained_boost(spark, sf, kind):
    """gbm / lgbm / cat stop early with patience on the validation rows; xgb is the grid's best
    cell, fitted on all training rows without early stop."""
    def fit():
        settings = tuned(spark, sf)[0] if kind == "xgb" else B.CONFIGS[kind]
        t0 = time.perf_counter()
        model = B.fit(train_validation(spark, sf), settings, "label", "vec_id", "embedding",
                      validation_col=None if kind == "xgb" else "is_validation", class_weights=kind in ("lgbm", "cat"))
        return model, time.perf_counter() - t0
    return _cached(spark, (kind, sf), fit)


def predict(model, df):
    """Class probabilities and prediction by a model of either kind."""
    owner = B if isinstance(model, B.BoostedModel) else FO
    return owner.score(model, df.drop("features"), "embedding")


def _scored_out(scored):
    return scored.select("vec_id", "label", "split", F.col("prediction"),
                         F.array_max("probability").alias("confidence"))


@register("forest_score")
def forest_score(spark, sf):
    model, _ = trained_forest(spark, sf)
    return _scored_out(predict(model, split(spark, sf)))


def _boost_query(kind):
    def q(spark, sf):
        model, _ = trained_boost(spark, sf, kind)
        return _scored_out(predict(model, split(spark, sf)))
    return q


for _kind in ("gbm", "lgbm", "xgb", "cat"):
    register(f"boosted_score_{_kind}")(_boost_query(_kind))


@register("early_stopping")
def early_stopping(spark, sf):
    """M5/M8: rounds built, best round and its validation loss of the models that stop with patience."""
    rows = []
    for kind in ("gbm", "cat"):
        info = trained_boost(spark, sf, kind)[0].info
        rows.append((kind, info["settings"].patience, info["built"], info["best"], float(info["losses"][info["best"] - 1])))
    return spark.createDataFrame(rows, "model string, patience int, rounds_built int, best_round int, best_val_loss double")


@register("model_metrics")
def model_metrics(spark, sf):
    """S7 canonical metrics table: one row per model on the test split."""
    rows = []
    specs = [("Random Forest", lambda: trained_forest(spark, sf)),
             ("GBM", lambda: trained_boost(spark, sf, "gbm"))]
    for name, fit in specs:
        model, secs = fit()
        test = split(spark, sf).where(F.col("split") == "test")
        m = E.summary_metrics(predict(model, test), "label", "prediction")
        rows.append(m.select(F.lit(name).alias("model"), F.lit(float(secs)).alias("training_time_seconds"),
                             "accuracy", "f1_score", "precision", "recall",
                             "matthews_corrcoef", "cohen_kappa"))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out


def _folds(spark, sf, k):
    return R.stratified_folds(emb(spark, sf).drop("features"), "label", "vec_id", k=k)


@register("cv_summary")
def cv_summary(spark, sf):
    """M11 + A34: 5-fold scores of the forest, mean and population std per metric."""
    k = 5
    found = FO.held_out(_folds(spark, sf, k), [FO.Settings()] * k, "label", "vec_id", "embedding",
                        [F.col("fold") != f for f in range(k)], [F.col("fold") == f for f in range(k)])
    per = spark.createDataFrame([{"fold": f, **FO.metrics(c)} for f, c in enumerate(found[0])])
    long = per.unpivot(["fold"], ["accuracy", "f1_score", "precision", "recall"], "metric", "value")
    return long.groupBy("metric").agg(F.avg("value").alias("mean"),
                                      F.stddev_pop("value").alias("std"))


@register("learning_curve")
def learning_curve(spark, sf):
    """R7 + A35: train on nested hashed fractions of the training folds; weighted F1 on
    the training part and on the held-out fold; mean and population std per size."""
    k, fractions = 3, R.learning_fractions()
    folds = _folds(spark, sf, k)
    for f in range(k):      # a row's place by hash order in its class, of the training rows and of the held-out ones
        folds = hash_rank(folds.withColumn("held", F.col("fold") == f), ["label", "held"], "vec_id", rank=f"place{f}",
                          total=f"of{f}").drop("__h")
    cells = [(f, frac) for f in range(k) for frac in fractions]
    part = [(F.col("fold") != f) & (F.col(f"place{f}") <= F.ceil(F.col(f"of{f}") * frac)) for f, frac in cells]
    folds, settings = folds.persist(), [FO.Settings()] * len(cells)
    found = FO.held_out(folds, settings, "label", "vec_id", "embedding", part, part, [F.col("fold") == f for f, _ in cells])
    folds.unpersist()
    rows = [(float(frac), f, *(FO.metrics(side[i])["f1_score"] for side in found)) for i, (f, frac) in enumerate(cells)]
    per = spark.createDataFrame(rows, "fraction double, fold int, train_f1 double, val_f1 double")
    return per.groupBy("fraction").agg(
        F.avg("train_f1").alias("train_mean"), F.stddev_pop("train_f1").alias("train_std"),
        F.avg("val_f1").alias("val_mean"), F.stddev_pop("val_f1").alias("val_std"))


# M9 search space of the reference (trees, depth, min split, min leaf, features); Spark has
# no min-split parameter and caps depth at 30 ("none" -> 30).
RF_SPACE = {"numTrees": [100, 200, 300], "maxDepth": [30, 15, 20],
            "minInstancesPerNode": [1, 2], "featureSubsetStrategy": ["sqrt", "log2"]}
RF_DRAWS = 10


@register("random_search")
def random_search(spark, sf):
    folds = _folds(spark, sf, 3)
    cells = M.sampled_grid(RF_SPACE, draws=RF_DRAWS)
    _, scores = M.search(folds, FO.Estimator("vec_id", "embedding"), cells, "fold", 3)
    return spark.createDataFrame(
        [(str(sorted(c.items())), float(s)) for c, s in scores], "params string, mean_f1 double")


@register("grid_search")
def grid_search(spark, sf):
    """Softmax boosting, every cell of the grid, 2 folds; ``best`` marks the cell that
    ``boosted_score_xgb`` is fitted with."""
    return tuned(spark, sf)[1]


def _importance(spark, sf):
    model, _ = trained_forest(spark, sf)
    rows = M.importances(model, NAMES, "Random Forest")
    gmodel, _ = trained_boost(spark, sf, "gbm")
    rows += M.importances(gmodel, NAMES, "GBM")
    return M.importance_frame(spark, rows)


@register("importance_topk")
def importance_topk(spark, sf):
    """A32 + K2 + A33: per model the top-20 features and their share of the shown total."""
    from pyspark.sql import Window
    imp = _importance(spark, sf)
    w = Window.partitionBy("model").orderBy(F.desc("importance"), F.asc("feature"))
    top = imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 20)
    share = F.col("importance") * 100.0 / F.sum("importance").over(Window.partitionBy("model"))
    return top.withColumn("share_percent", F.round(share, 6))


@register("importance_chart")
def importance_chart(spark, sf):
    """K3: per model the 10 largest |importance| features, non-finite values dropped first."""
    from pyspark.sql import Window
    imp = _importance(spark, sf).where(~F.isnan("importance") & (F.abs("importance") != float("inf")))
    w = Window.partitionBy("model").orderBy(F.abs("importance").desc(), F.asc("feature"))
    return imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 10)


@register("key_features")
def key_features(spark, sf):
    """K3 + J4 + F6/F7: per model the top-3 |importance| features (non-finite dropped)
    with every row's value, prettified name and 2-decimal text."""
    from pyspark.sql import Window
    from flowlens.functions import scalar as XS
    imp = _importance(spark, sf).where(~F.isnan("importance"))
    w = Window.partitionBy("model").orderBy(F.abs("importance").desc(), F.asc("feature"))
    top3 = imp.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= 3)
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    vals = e.select("vec_id", F.posexplode("embedding").alias("pos", "value")).withColumn(
        "feature", F.concat(F.lit("e"), F.col("pos").cast("string")))
    j = vals.join(F.broadcast(top3), "feature")  # top3: at most 3 rows per model
    return j.select("vec_id", "model", "rank", XS.prettify(F.col("feature")).alias("feature_label"),
                    XS.fmt2(F.col("value")).alias("value_text"), F.round("importance", 4).alias("importance"))


@register("feature_select")
def feature_select(spark, sf):
    """M12 + A40 + U1 + U2: forest importance > .01 union mutual information > .01;
    ``selected`` false marks the set difference (columns not in the union)."""
    imp = _importance(spark, sf).where(F.col("model") == "Random Forest")
    e = table(spark, sf, "embeddings").select("label", *[F.col("embedding")[i].cast("double").alias(n)
                                                          for i, n in enumerate(NAMES)])
    mi = P.mutual_information(e, NAMES, "label")
    forest_set = imp.where(F.col("importance") > 0.01).select("feature")
    mi_set = mi.where("selected").select("feature")
    union = forest_set.union(mi_set).distinct().withColumn("selected", F.lit(True))
    all_f = mi.select("feature", F.col("mutual_information"))
    j = all_f.join(imp.select("feature", "importance"), "feature", "left").join(union, "feature", "left")
    return j.select("feature", F.round("importance", 6).alias("importance"), "mutual_information",
                    F.coalesce("selected", F.lit(False)).alias("selected"))


@register("shapley")
def shapley(spark, sf):
    """M14 + K4: per row the 10 largest |Shapley value| features for class 1 of the forest,
    background = 10 k-means centres, 2 hashed permutations (128 coalitions for each centre;
    the reference takes 100)."""
    model, _ = trained_forest(spark, sf)
    e = emb(spark, sf)
    bg = _cached(spark, ("kmeans", sf), lambda: X.kmeans_background(e, k=10))
    vals = X.shapley(spread(spark, e), "vec_id", "embedding", model, bg, NAMES, class_index=1, permutations=2)
    return X.top_attributions(vals, "vec_id", 10)


@register("tree_shapley")
def tree_shapley(spark, sf):
    """M14 + K4: exact path-dependent Shapley values of the forest for class 1, the 10 largest of
    every row, without a background or drawn feature sets."""
    model, _ = trained_forest(spark, sf)
    vals = T.tree_shapley(spread(spark, emb(spark, sf)), "embedding", model, class_index=1)
    top = F.explode(T.largest(F.col("shap_values"), NAMES, 10)).alias("top")
    return vals.select("vec_id", "base_value", top).select("vec_id", "base_value", "top.*")


@register("tree_shapley_sums", """
SELECT vec_id, len(embedding) AS n_features, true AS adds_up FROM embeddings
""")
def tree_shapley_sums(spark, sf):
    """Whether every row's base value and Shapley values add up to the probability that the
    forest itself gives."""
    model, _ = trained_forest(spark, sf)
    vals = predict(model, T.tree_shapley(spread(spark, emb(spark, sf)), "embedding", model, class_index=1))
    total = F.aggregate("shap_values", F.col("base_value"), lambda a, v: a + v)
    return vals.select("vec_id", F.size("shap_values").cast("long").alias("n_features"),
                       (F.abs(total - F.col("probability")[1]) < 1e-9).alias("adds_up"))


_DRAWN_SQL = " + ".join(f"CAST(u >= {x!r}e0 AS INTEGER)" for x in BS.LIMITS)


@register("bootstrap_weights", f"""
WITH r AS (SELECT label, t.tree::INTEGER AS tree,
             ('0x' || substr(md5(vec_id::VARCHAR || ':' || t.tree::VARCHAR), 1, 13))::UBIGINT::DOUBLE / 4503599627370496e0 AS u
           FROM embeddings, range(100) t(tree) WHERE vec_id IS NOT NULL AND label IS NOT NULL),
c AS (SELECT tree, label, CAST(sum({_DRAWN_SQL}) AS BIGINT) AS n_rows FROM r GROUP BY tree, label)
SELECT tree, label, n_rows, sum(n_rows) OVER (PARTITION BY tree) / (count(*) OVER (PARTITION BY tree) * n_rows) AS weight
FROM c WHERE n_rows > 0
""")
def bootstrap_weights(spark, sf):
    """Class weights within each of the 100 bootstraps of a forest."""
    return BS.class_weights(table(spark, sf, "embeddings").select("vec_id", "label"), "vec_id", "label", 100)


@register("local_surrogate")
def local_surrogate(spark, sf):
    """Weighted ridge around each row (5000 hashed perturbations, the library's
    default), top-10 |coef|."""
    from flowlens.operators.scale import standard_stats
    model, _ = trained_forest(spark, sf)
    e = emb(spark, sf)
    cols = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(n)
                                                   for i, n in enumerate(NAMES)])
    st = standard_stats(cols, NAMES)
    return X.local_surrogate(spread(spark, e), "vec_id", "embedding", model, [st[n][0] for n in NAMES],
                             [st[n][1] for n in NAMES], NAMES, samples=5000)


@register("smote")
def smote(spark, sf):
    """Every class oversampled to the majority size."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return SM.smote(e, "vec_id", "label", "embedding")


@register("smote_neighbours", """
WITH p AS (SELECT min(vec_id) AS id, label, embedding::DOUBLE[] AS v, count(*) AS m FROM embeddings
           WHERE label IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
           GROUP BY label, embedding),
near AS (SELECT a.label, a.id AS vec_id, b.id AS near_id, list_distance(a.v, b.v) AS distance, a.m AS own, b.m AS m
         FROM p a JOIN p b ON a.label = b.label AND a.id <> b.id),
ranked AS (SELECT *, own - 1 + coalesce(sum(m) OVER (PARTITION BY vec_id ORDER BY distance, near_id
           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM near)
SELECT label, vec_id, near_id, distance, CAST(least(before + m, 5) AS BIGINT) AS rows_until FROM ranked WHERE before < 5
UNION ALL SELECT label, id, id, 0.0, CAST(least(m - 1, 5) AS BIGINT) FROM p WHERE m > 1
""")
def smote_neighbours(spark, sf):
    """The 5 nearest other rows of the same class, of every distinct point (named by its
    smallest id; ``rows_until``: rows up to and with this point, own copies first)."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    ids = e.withColumn("embedding", F.col("embedding").cast("array<double>")).groupBy("label", "embedding").agg(
        F.min("vec_id").alias("vec_id"))
    near = SM.same_class_neighbours(e, "vec_id", "label", "embedding").withColumnRenamed("__arr", "embedding")
    return near.join(ids, ["label", "embedding"]).select("label", "vec_id", F.inline("nbrs")).select(
        "label", "vec_id", F.col("q").alias("near_id"), F.col("d").alias("distance"),
        F.col("cum_end").alias("rows_until"))


@register("smote_to_plan")
def smote_to_plan(spark, sf):
    """R4 + R5: classes below n/k oversampled to int(n/k), others unchanged."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    return SM.smote(e, "vec_id", "label", "embedding", plan=R.rebalance_plan(e, "label"))


@register("background_sample", """
SELECT vec_id, label FROM embeddings
WHERE len(list_filter(embedding, lambda x: isnan(x) OR isinf(x))) = 0
ORDER BY md5(CAST(vec_id AS VARCHAR)), vec_id LIMIT 100
""")
def background_sample(spark, sf):
    """Background rows for explanations: finite rows (P5), 100 by hash order."""
    e = table(spark, sf, "embeddings").select("vec_id", "label", "embedding")
    ok = e.where(F.forall(F.col("embedding").cast("array<double>"),
                          lambda v: ~F.isnan(v) & (F.abs(v) != float("inf"))))
    return R.fixed_sample(ok, "vec_id", 100).select("vec_id", "label")
