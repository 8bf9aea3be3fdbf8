"""The ML queries fit all ten classes with the reference's settings (fits are recorded, not run)."""

import itertools

import pytest
from pyspark.sql import functions as F

from flowlens import workflows as W
from flowlens.operators import boosting as B
from flowlens.operators import ensemble as M
from flowlens.operators import explain as X
from flowlens.plans import q_ml as Q
from flowlens.plans import q_verdict as QV
from tests.conftest import SF001


class Stop(Exception):
    pass


@pytest.mark.parametrize("kind", sorted(B.CONFIGS))
def test_boosting_sees_ten_classes_and_its_rounds(spark, monkeypatch, kind):
    seen = {}

    def fit(df, settings, *a, **kw):
        seen.update(kw, settings=settings, labels={r[0] for r in df.select("label").distinct().collect()})
        raise Stop

    monkeypatch.setattr(Q, "_CACHE", {})
    monkeypatch.setattr(Q, "tuned", lambda *a: (B.CONFIGS["xgb"], None))
    monkeypatch.setattr(B, "fit", fit)
    with pytest.raises(Stop):
        Q.trained_boost(spark, SF001, kind)
    assert seen["labels"] == set(map(float, range(10))) and seen["settings"] == B.CONFIGS[kind]
    assert (seen["validation_col"] is None) == (kind == "xgb") and "rows" not in seen
    spark_settings = M.BOOST_CONFIGS[kind]
    assert (seen["settings"].rounds, seen["settings"].rate, seen["settings"].depth) == tuple(
        spark_settings[k] for k in ("maxIter", "stepSize", "maxDepth"))


def test_searches_take_the_whole_space(spark, monkeypatch):
    seen = []

    def search(df, estimator, cells, fold, k):
        seen.append((cells, k, df.select("label").distinct().count()))
        return None, [(c, 0.0) for c in cells]

    def grid_search(df, base, grid, *a, **kw):
        seen.append((grid, a[-1], df.select("label").distinct().count()))
        raise Stop

    monkeypatch.setattr(Q, "_CACHE", {})
    monkeypatch.setattr(M, "search", search)
    monkeypatch.setattr(B, "search", grid_search)
    Q.random_search(spark, SF001)
    with pytest.raises(Stop):
        Q.grid_search(spark, SF001)
    (forest, k3, n3), (grid, k2, n2) = seen
    assert (len(forest), k3, n3, k2, n2) == (10, 3, 10, 2, 10) and all(c["numTrees"] >= 100 for c in forest)
    assert grid["rounds"] == [500, 1000] and len(list(itertools.product(*grid.values()))) == 32


def test_search_reaches_the_classifier_of_one_vs_rest(spark):
    df = M.with_features(spark.createDataFrame(
        [(float(i % 3), i % 2, [float(i % 3), float(i)]) for i in range(36)], "label double, fold int, arr array<double>"), "arr")
    model, scores = M.search(df, M.boosted("xgb"), [{"maxIter": 2, "maxDepth": 1}], "fold", 2)
    assert [m.getNumTrees for m in model.bestModel.models] == [2, 2, 2] and scores[0][1] > 0.5


def test_forest_and_explanations(spark, monkeypatch):
    seen = {}

    def fit(est, df):
        seen.update(trees=est.getNumTrees(), depth=est.getMaxDepth())
        raise Stop

    def told(name):
        def f(*a, **kw):
            seen[name] = kw
            raise Stop
        return f

    monkeypatch.setattr(Q, "_CACHE", {})
    monkeypatch.setattr(M, "fit_persisted", fit)
    with pytest.raises(Stop):
        Q.trained_forest(spark, SF001)
    assert (seen["trees"], seen["depth"]) == (100, 30)
    monkeypatch.setattr(Q, "trained_forest", lambda *a: (None, 0))
    monkeypatch.setattr(X, "kmeans_background", told("centres"))
    monkeypatch.setattr(X, "local_surrogate", told("surrogate"))
    monkeypatch.setattr(W, "train_models", told("flows"))
    for q in (Q.shapley, Q.local_surrogate, QV.flow_consensus):
        with pytest.raises(Stop):
            q(spark, SF001)
    assert seen["centres"]["k"] == 10 and seen["surrogate"]["samples"] == 5000 and not seen["flows"].get("small")
    assert len(Q.R.learning_fractions()) == 5
    assert Q.emb(spark, SF001).where(F.col("label") > 2).count() > 0
