import numpy as np
import pytest

from flowlens.operators import bootstrap as B
from flowlens.operators import ensemble as M


def _rows(spark, n=400):
    rng = np.random.default_rng(4)
    rows = [(i, float(i % 10 == 0), [float(rng.normal() + 3 * (i % 10 == 0)), float(rng.normal())]) for i in range(n)]
    return spark.createDataFrame(rows, "id long, label double, arr array<double>")


def test_draws_are_poisson_and_repeatable(spark):
    df = spark.range(20_000)
    got = df.select(B.drawn(df.id, df.id * 0 + 3).alias("n")).toPandas().n
    assert abs(got.mean() - 1) < 0.03 and abs(got.var() - 1) < 0.05
    assert abs((got == 0).mean() - np.exp(-1)) < 0.02
    again = df.repartition(5).select("id", B.drawn(df.id, df.id * 0 + 3).alias("n")).toPandas().sort_values("id").n
    assert got.tolist() == again.tolist()


def test_every_bootstrap_is_balanced(spark):
    df = _rows(spark).unionByName(spark.createDataFrame(
        [(None, 1.0, [0.0, 0.0]), (900, None, [0.0, 0.0])], "id long, label double, arr array<double>"))
    got = B.class_weights(df, "id", "label", 6).toPandas()
    assert sorted(got.tree.unique()) == list(range(6)) and got.label.notna().all()
    for _, part in got.groupby("tree"):
        share = part.n_rows * part.weight
        assert np.allclose(share, part.n_rows.sum() / len(part))


def test_trees_learn_the_rare_class(spark):
    df = M.with_features(_rows(spark), "arr")
    models = B.fit(df, "id", "label", trees=5, max_depth=4)
    out = B.predict(models, df).select("label", "probability", "prediction").toPandas()
    assert len(models) == 5 and np.allclose(out.probability.map(sum), 1)
    rare = out[out.label == 1]
    assert (rare.prediction == 1).mean() > 0.9 and (out.label == out.prediction).mean() > 0.85


def test_a_class_missing_in_a_bootstrap_keeps_its_place(spark):
    """Class 2 has one row: some trees never draw it, yet every tree has three probabilities."""
    rows = [(i, float(i % 2), [float(i % 2), 0.0]) for i in range(40)] + [(99, 2.0, [5.0, 5.0])]
    df = M.with_features(spark.createDataFrame(rows, "id long, label double, arr array<double>"), "arr")
    held = B.class_weights(df, "id", "label", 4).where("label = 2").count()
    models = B.fit(df, "id", "label", trees=4, max_depth=3)
    assert held < 4 and all(m.numClasses == 3 for m in models)
    assert all(len(r.probability) == 3 for r in B.predict(models, df).collect())


def test_no_labelled_rows(spark):
    df = M.with_features(spark.createDataFrame([(1, None, [0.0])], "id long, label double, arr array<double>"), "arr")
    with pytest.raises(ValueError, match="no labelled rows"):
        B.fit(df, "id", "label", trees=2)
