"""Softmax boosting: trees against brute force, prefixes against separate fits, patience, scoring."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens import workflows as W
from flowlens.operators import boosting as B

SCHEMA = "k string, label double, x array<double>, is_validation boolean, fold int"


def cloud(n, classes=3, features=4, seed=0, noise=0.6):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, classes, n)
    centre = rng.normal(size=(classes, features)) * 2
    return centre[y] + rng.normal(size=(n, features)) * noise, y


def frame(spark, x, y, start=0):
    rows = [(f"k{start + i}", float(c), [float(v) for v in r], i % 5 == 0, i % 2) for i, (r, c) in enumerate(zip(x, y))]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def brute_tree(codes, g, h, depth, s):
    """Value of every row in the best tree, by trying every split of every node."""
    value = lambda r: -np.sign(g[r].sum()) * max(abs(g[r].sum()) - s.l1, 0) / (h[r].sum() + s.l2)
    part = lambda r: max(abs(g[r].sum()) - s.l1, 0) ** 2 / (h[r].sum() + s.l2)

    def walk(rows, left):
        best = (2 * s.gamma, None)
        if left:
            for f in range(codes.shape[1]):
                for cut in range(B.BINS):
                    a, b = rows[codes[rows, f] <= cut], rows[codes[rows, f] > cut]
                    if len(a) >= s.min_rows and len(b) >= s.min_rows and min(h[a].sum(), h[b].sum()) >= max(s.min_weight, 1e-12):
                        gain = part(a) + part(b) - part(rows)
                        if gain > best[0] + 1e-12:
                            best = (gain, (a, b))
        if best[1] is None:
            out = np.zeros(len(codes))
            out[rows] = value(rows)
            return out
        return walk(best[1][0], left - 1) + walk(best[1][1], left - 1)

    return walk(np.arange(len(codes)), depth)


@pytest.mark.parametrize("settings", [B.Settings(depth=3, l2=1.0), B.Settings(depth=2, gamma=0.3, l1=0.1, min_rows=4),
                                      B.Settings(depth=4, min_weight=1.0, l2=0.5)])
def test_trees_equal_brute_force(settings):
    rng = np.random.default_rng(3)
    for _ in range(5):
        codes = rng.integers(0, 9, (60, 3)).astype(np.uint8)
        g, h = rng.normal(size=(60, 2)), rng.random((60, 2)) + 0.1
        nodes, at, _ = B.grow(codes, g, h, np.ones(60, bool), settings, rng)
        for k in range(2):
            assert np.allclose(nodes["value"][at[:, k]], settings.rate * brute_tree(codes, g[:, k], h[:, k], settings.depth, settings))


def test_leaf_limit_and_flat_scoring():
    x, y = cloud(200)
    edges = B.bin_edges(x)
    codes = B.binned(x, edges)
    s = B.Settings(rounds=7, depth=15, leaves=5, rows=0.7, columns=0.5, node_columns="sqrt")
    found = B.fit_codes(codes, y, np.ones(200), 3, s)
    model = B.BoostedModel(found["rounds"], edges, 3, found["importance"], {})
    for r in found["rounds"]:
        assert len(r["value"]) == 3 + 2 * (r["feature"] >= 0).sum() and (r["feature"] >= 0).sum() <= 3 * 4
    p = model.probabilities(x)
    assert np.allclose(p.sum(axis=1), 1) and (p.argmax(axis=1) == y).mean() > 0.9
    assert found["importance"].sum() == pytest.approx(1)


def test_loss_falls_every_round():
    x, y = cloud(150, noise=1.0)
    codes = B.binned(x, B.bin_edges(x))
    found = B.fit_codes(codes, y, np.ones(150), 3, B.Settings(rounds=30, depth=3))
    model = B.BoostedModel(found["rounds"], [np.zeros(0)] * 4, 3, found["importance"], {})
    stages = model.margins(codes, list(range(1, 31)))
    losses = [B.log_loss(B.softmax(stages[t]), y, np.ones(150)) for t in range(1, 31)]
    assert all(b < a for a, b in zip(losses, losses[1:]))


def test_prefix_scores_equal_separate_fits(spark):
    x, y = cloud(240, noise=2.5, seed=4)
    df = frame(spark, x, y)
    grid = {"depth": [2, 3], "rate": [0.3], "rounds": [3, 9], "gamma": [0.0, 0.2]}
    base = B.Settings(min_rows=2, rows=0.8, l2=1.0)
    scores = B.search(df, base, grid, "label", "k", "x", "fold", 2)
    got = {(r.depth, r.gamma, r.rounds, r.fold): r.f1 for r in scores.collect()}
    assert len(got) == 2 * 2 * 2 * 2
    data = B._sample(df, "label", "k", "x", B.TUNE_ROWS, ["fold"])
    for (depth, gamma, rounds, fold), f1 in got.items():
        s = B.Settings(rounds=rounds, depth=int(depth), rate=0.3, gamma=gamma, min_rows=2, rows=0.8, l2=1.0)
        teach = data["fold"] != fold
        found = B.fit_codes(data["codes"][teach], data["y"][teach], np.ones(teach.sum()), 3, s)
        model = B.BoostedModel(found["rounds"], data["edges"], 3, found["importance"], {})
        assert f1 == B.weighted_f1(data["y"][~teach], model.margins(data["codes"][~teach]).argmax(axis=1), 3)
    chosen, means = B.best_settings(scores, base, grid)
    table = means.collect()
    assert len(table) == 8 and sum(r.best for r in table) == 1
    top = next(r for r in table if r.best)
    assert top.mean_f1 == pytest.approx(max(r.mean_f1 for r in table)) and (chosen.depth, chosen.rounds) == (top.depth, top.rounds)


def test_patience_outlasts_a_bump(spark):
    """The loss rises for some rounds and falls again: patience 1 stops before, patience 15 does not."""
    x, y = cloud(120, noise=2.0, seed=9)
    codes = B.binned(x, B.bin_edges(x))
    held = np.arange(120) % 3 == 0
    noisy = B.Settings(rounds=60, depth=3, rate=0.15, rows=0.3)
    runs = [B.fit_codes(codes, y, np.ones(120), 3, B.replace(noisy, patience=p), held) for p in (1, 15)]
    assert runs[0]["built"] < runs[1]["built"] and runs[1]["losses"][runs[1]["best"] - 1] < runs[0]["losses"][runs[0]["best"] - 1]
    losses = runs[1]["losses"][:runs[1]["best"]]
    assert any(b > a for a, b in zip(losses, losses[1:]))            # a bump before the best round
    assert len(runs[1]["rounds"]) == runs[1]["best"] == int(np.argmin(runs[1]["losses"])) + 1 < runs[1]["built"]
    model = B.fit(frame(spark, x, y), B.replace(noisy, patience=15), "label", "k", "x", "is_validation", class_weights=True)
    assert model.num_rounds == model.info["best"] < model.info["built"]


def test_fit_rows_are_bounded_and_keep_rare_classes(spark):
    rows = spark.range(20000).select(F.col("id").cast("string").alias("k"), F.when(F.col("id") < 60, 1.0).when(
        F.col("id") < 19000, 0.0).alias("label"))
    got = {r[0]: r[1] for r in B.fit_rows(rows, "label", "k", 1000).groupBy("label").count().collect()}
    assert set(got) == {0.0, 1.0} and 800 < got[0.0] < 1200 and got[1.0] >= 35
    assert B.fit_rows(rows.repartition(7), "label", "k", 1000).count() == sum(got.values())


def test_score_handles_gaps(spark):
    x, y = cloud(90)
    model = B.fit(frame(spark, x, y), B.Settings(rounds=5, depth=2), "label", "k", "x")
    odd = spark.createDataFrame([("a", [1.0, None, 2.0, 3.0]), ("b", None), ("c", [1.0]), ("d", [float("nan"), 1.0, 2.0, 3.0]),
                                 ("e", [float(v) for v in x[0]])], "k string, x array<double>")
    got = {r.k: r for r in B.score(model, odd, "x").collect()}
    assert all(got[k].prediction is None and got[k].probability is None for k in "abc")
    assert abs(sum(got["d"].probability) - 1) < 1e-9
    assert np.allclose(got["e"].probability, model.probabilities(x[:1])[0])
    assert B.score(model, odd.limit(0), "x").count() == 0


def test_workflow_takes_null_labels_out_of_the_fit(spark):
    rows = [(f"f{i}", ["BENIGN", "DoS", None][i % 3], float(i % 3), float(i)) for i in range(90)]
    df = spark.createDataFrame(rows, "k string, label string, a double, b double")
    models, metrics = W.train_models(df, "k", "label", ["a", "b"], small=True, substring_rules=[], mapping={}, excluded=[])
    assert set(models) == {"Random Forest", "GBM"} and metrics.count() == 2


def test_small_nodes_get_no_histogram(monkeypatch):
    """Nodes too small for two children are leaves at once, and the last level needs no histograms: the same trees
    from far fewer bins (one node of a level before: features x bins)."""
    x, y = cloud(300, noise=2.0, seed=2)
    codes, seen, count = B.binned(x, B.bin_edges(x)), [], np.bincount

    def bincount(a, weights=None, minlength=0):
        seen.append(minlength)
        return count(a, weights, minlength)

    monkeypatch.setattr(B.np, "bincount", bincount)
    found = B.fit_codes(codes, y, np.ones(300), 3, B.Settings(rounds=1, depth=8, min_rows=40))
    nodes = found["rounds"][0]
    assert max(seen) <= len(nodes["feature"]) * B.BINS and (nodes["feature"] >= 0).sum() > 3
    at = np.tile(np.arange(3), (300, 1))
    while (nodes["feature"][at] >= 0).any():
        f = nodes["feature"][at]
        at = np.where(f >= 0, nodes["left"][at] + (codes[np.arange(300)[:, None], np.maximum(f, 0)] > nodes["cut"][at]), at)
    assert min(count(at[:, k])[np.unique(at[:, k])].min() for k in range(3)) >= 40
