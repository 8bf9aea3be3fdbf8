"""Fits see every labelled row, whatever their number; edges come from whole columns."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import binning
from flowlens.operators import boosting as B
from flowlens.operators import forest as FO
from tests.test_boosting import cloud, frame


def test_edges_equal_numpy_over_whole_columns(spark):
    rng = np.random.default_rng(4)
    n = 3000
    x = np.stack([rng.normal(size=n), rng.normal(size=n).astype(np.float32), np.round(rng.normal(size=n), 1), rng.integers(-5, 20, n),
                  np.full(n, 7.0), np.exp(40 * rng.normal(size=n)), np.where(rng.random(n) < 0.3, -0.0, rng.normal(size=n)),
                  np.full(n, np.nan)], 1)
    x[rng.random(x.shape) < 0.02] = np.nan
    x[rng.random(x.shape) < 0.02] = np.inf
    df = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(3)
    for halfway, plain in ((False, B.bin_edges), (True, FO.bin_edges)):
        for got, want in zip(binning.edges(df, 8, 32, halfway), plain(x), strict=True):
            np.testing.assert_array_equal(got, want)
    whole = spark.createDataFrame([(float(i),) for i in range(500)], "v double").select(F.array("v").alias("x"))
    np.testing.assert_array_equal(binning.edges(whole, 1, 32, False)[0], B.bin_edges(np.arange(500.0)[:, None])[0])
    assert [len(e) for e in binning.edges(df.limit(0), 8, 32, True)] == [0] * 8


@pytest.mark.parametrize("patience", [0, 4])
def test_more_rows_than_one_task_takes_are_all_learnt_from(spark, patience):
    """Rows whose label only their own place tells: a model of a share of them could not know the others."""
    x, y = cloud(400, classes=3, noise=1.5, seed=6)
    df = frame(spark, x, y)
    s = B.Settings(rounds=12, depth=3, rate=0.3, rows=0.8, columns=0.7, patience=patience)
    model = B.fit(df, s, "label", "k", "x", "is_validation" if patience else None, one_task=50)
    data = B._whole(df, "label", "k", "x", 50, ["is_validation"])
    assert len(data["y"]) == 400 and all(np.array_equal(a, b) for a, b in zip(data["edges"], B.bin_edges(x), strict=True))
    near = B._whole(df, "label", "k", "x", 1000, ["is_validation"])
    assert sorted(map(bytes, data["codes"])) == sorted(map(bytes, near["codes"])) and sorted(data["y"]) == sorted(near["y"])
    name = "is_validation" if patience else None
    held = data["is_validation"].astype(bool) if patience else None
    one, rounds = B.Replica(data, s, False, name, B.SEED), []
    for _ in range(model.info["built"]):
        rounds.append([one.grown([c])[c][0] for c in range(3)])
        one.advance(rounds[-1])
    want = B.BoostedModel([B._beside(r) for r in rounds[:model.info["best"]]], data["edges"], 3, model.importance, {})
    for k in ("feature", "cut", "left", "value", "roots"):
        np.testing.assert_array_equal(getattr(model, k), getattr(want, k))
    assert model.info["best"] == (int(np.argmin(model.info["losses"])) + 1 if patience else 12) and not B.REPLICAS
    assert (model.probabilities(x).argmax(1) == y).mean() > 0.8 and model.importance.sum() == pytest.approx(1)
    plain = B.replace(s, rows=1.0, columns=1.0)                          # without draws both kinds grow the same trees
    found = B.fit_codes(data["codes"], data["y"], np.ones(400), 3, plain, held)
    same = B.fit(df, plain, "label", "k", "x", name, one_task=50)
    assert [same.info[k] for k in ("built", "best")] == [found[k] for k in ("built", "best")]
    for i, a in enumerate(found["rounds"]):
        b = slice(same.roots[i], same.roots[i + 1] if i + 1 < len(same.roots) else None)
        assert sorted(a["value"]) == pytest.approx(sorted(same.value[b])) and sorted(a["feature"]) == sorted(same.feature[b])


def test_no_row_of_a_search_or_fit_is_left_out(spark, monkeypatch):
    x, y = cloud(300)
    df = frame(spark, x, y)
    monkeypatch.setattr(B, "TUNE_ROWS", 40)
    seen, kept = [], B._whole
    monkeypatch.setattr(B, "_whole", lambda *a, **b: seen.append(d := kept(*a, **b)) or d)
    B.search(df, B.Settings(rounds=2, depth=2), {"rounds": [1, 2]}, "label", "k", "x", "fold", 2).collect()
    B.fit(df, B.Settings(rounds=2, depth=2), "label", "k", "x", one_task=40)
    assert [len(d["y"]) for d in seen] == [300, 300]
