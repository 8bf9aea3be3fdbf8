"""SMOTE neighbours where the triangle inequality prunes little: seeds go to groups of tiles, results stay exact."""

import numpy as np

from flowlens.operators import smote as SM


def test_seeds_visit_groups_not_tiles(spark, monkeypatch):
    x = np.random.default_rng(8).normal(size=(1200, 32))
    df = spark.createDataFrame([(i, 1, v.tolist()) for i, v in enumerate(x)], "id long, label int, arr array<double>")
    asked, run = [], SM.nearest_in_rings

    def counted(ask, index, sizes, k):
        asked.append(ask.count())
        return run(ask, index, sizes, k)

    monkeypatch.setattr(SM, "nearest_in_rings", counted)
    got = SM.same_class_neighbours(df, "id", "label", "arr").collect()
    assert asked[0] == 1200 and asked[1] <= 6 * 1200       # 34 tiles, nearly all open for every seed
    at = {tuple(v): i for i, v in enumerate(x.tolist())}
    for r in got[::30]:
        d = np.sqrt(((x - np.array(r["__arr"])) ** 2).sum(axis=1))
        d[at[tuple(r["__arr"])]] = np.inf
        assert [e["q"] for e in r["nbrs"]] == np.argsort(d, kind="stable")[:5].tolist()
        assert [e["cum_end"] for e in r["nbrs"]] == [1, 2, 3, 4, 5]


def test_pivot_order_keeps_near_ones_together():
    centres = np.array([[0.0, 0], [100, 0], [0, 100], [100, 100]])
    pivots = centres[np.arange(64) % 4] + np.random.default_rng(1).normal(size=(64, 2))
    place = SM.pivot_order(pivots)
    assert sorted(place) == list(range(64))
    cluster = (np.arange(64) % 4)[place.argsort()]
    assert (np.diff(cluster) != 0).sum() == 3
