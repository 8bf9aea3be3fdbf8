"""The bucketed window helpers and the quantile selection equal their single-task twins."""

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from flowlens.operators import profile as P
from flowlens.operators import scale as SC
from flowlens.operators import windows as W


def _data(spark, n=3000):
    rng = np.random.default_rng(7)
    rows = [(i, int(g), float(v), float(round(v, 1))) for i, (g, v) in
            enumerate(zip(rng.integers(0, 3, n), rng.normal(size=n)))]
    # a hot group: group 0 holds most rows
    rows += [(n + i, 0, float(i % 17), float(i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "id long, g int, v double, t double")


def test_global_lag_matches_window(spark):
    df = _data(spark)
    got = {r["id"]: r["v_prev"] for r in W.global_lag(df, "id", ["v"], n_buckets=7).collect()}
    ref = {r["id"]: r["p"] for r in df.select("id", F.lag("v").over(Window.orderBy("id")).alias("p")).collect()}
    assert got == ref


def test_grouped_lag_matches_window(spark):
    df = _data(spark)
    got = {r["id"]: r["v_prev"] for r in
           W.global_lag(df, "id", ["v"], groups=["g"], n_buckets=5).collect()}
    ref = {r["id"]: r["p"] for r in df.select(
        "id", F.lag("v").over(Window.partitionBy("g").orderBy("id")).alias("p")).collect()}
    assert got == ref
    got_w = {r["id"]: r["v_prev"] for r in
             W.global_lag(df, "id", ["v"], groups=["g"], width=250.0).collect()}
    assert got_w == ref


def test_running_sum_matches_window(spark):
    df = _data(spark).groupBy("g", "t").agg(F.count(F.lit(1)).alias("c"))
    got = {(r["g"], r["t"]): r["c_cum"] for r in W.running_sum(df, ["g"], "t", ["c"], n_buckets=6).collect()}
    w = Window.partitionBy("g").orderBy(F.desc("t")).rowsBetween(Window.unboundedPreceding, 0)
    ref = {(r["g"], r["t"]): r["x"] for r in df.select("g", "t", F.sum("c").over(w).alias("x")).collect()}
    assert got == ref


def test_hash_rank_is_exact(spark):
    df = _data(spark)
    got = {r["id"]: r["rank"] for r in W.hash_rank(df, ["g"], "id").collect()}
    w = Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id")
    ref = {r["id"]: r["r"] for r in df.select("id", F.row_number().over(w).alias("r")).collect()}
    assert got == ref


def test_exact_quantiles_match_numpy(spark):
    df = _data(spark)
    vals = np.array([r["v"] for r in df.collect()])
    q = SC.exact_quantiles(df, ["v", "t"], [0.25, 0.5, 0.75], bins=16)
    assert np.allclose(q["v"], np.percentile(vals, [25, 50, 75]), rtol=0, atol=1e-12)
    tv = np.array([r["t"] for r in df.collect()])
    assert np.allclose(q["t"], np.percentile(tv, [25, 50, 75]))


def test_partition_count_does_not_change_results(spark):
    df = _data(spark)
    a = sorted(P.distinct_ratio(df, ["v", "t"]).collect())
    b = sorted(P.distinct_ratio(df.repartition(3), ["v", "t"]).collect())
    assert a == b


def test_perfect_increments_and_constant(spark):
    df = spark.createDataFrame([(i, float(2 * i), 5.0, float(i * i)) for i in range(50)],
                               "id long, two double, const double, sq double")
    res = {r["feature"]: r["perfect_increments"] for r in
           P.perfect_increments(df, "id", ["two", "const", "sq"], n_buckets=4).collect()}
    assert res == {"two": True, "const": True, "sq": False}
    keep = {r["feature"]: r["keep"] for r in P.constant_features(df, ["two", "const"]).collect()}
    assert keep == {"two": True, "const": False}


def test_correlated_drop_double_column(spark):
    rows = [(float(i), float(2 * i), float((i * 7919) % 13)) for i in range(100)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    drop = {r["feature"]: r["dropped"] for r in P.correlated_drop(df, ["a", "b", "c"]).collect()}
    assert drop == {"a": False, "b": True, "c": False}
    corr = {(r["feature_a"], r["feature_b"]): r["abs_corr"] for r in P.abs_correlations(df, ["a", "b"]).collect()}
    assert corr[("a", "b")] == 1.0
    const = spark.createDataFrame([(1.0, float(i)) for i in range(5)], "k double, x double")
    assert P.abs_correlations(const, ["k", "x"]).first()["abs_corr"] is None


def test_correlations_are_pairwise_complete_at_any_width(spark):
    import numpy as np
    import pandas as pd
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 30)) + rng.normal(size=(300, 1))
    x[rng.random(x.shape) < 0.2] = np.nan
    x[:, 3] = 7.0
    pdf = pd.DataFrame(x, columns=[f"c{i}" for i in range(30)])
    df = spark.createDataFrame([tuple(None if np.isnan(v) and i % 2 else float(v) for i, v in enumerate(r)) for r in x],
                               ", ".join(f"c{i} double" for i in range(30)))
    want = pdf.corr().abs()
    for width in (5, 30):
        for r in P.abs_correlations(df, list(pdf.columns[:width])).collect():
            exp = want.loc[r.feature_a, r.feature_b]
            assert (r.abs_corr is None and np.isnan(exp)) or abs(r.abs_corr - exp) < 2e-6


def test_null_labels_and_scores_are_kept(spark):
    from flowlens.operators import evaluate as E
    from flowlens.operators import sample as R
    rows = [(i, None if i % 10 == 0 else "ab"[i % 2]) for i in range(100)]
    df = spark.createDataFrame(rows, "k long, label string")
    assert R.stratified_split(df, "label", "k").count() == R.stratified_folds(df, "label", "k").count() == 100
    assert R.undersample(df, "label", "k", R.smallest_class_plan(df, "label")).count() == 30
    scored = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", None), (None, "b")], "t string, p string")
    assert E.summary_metrics(scored, "t", "p").first().accuracy == 0.5
    assert sum(r.n for r in E.confusion_matrix(scored, "t", "p").collect()) == 4


def test_title_case_and_extremes(spark):
    from flowlens.functions import fixed, scalar as X
    from flowlens.operators import features as FE
    names = [*fixed.FLOW_FEATURES, "flow_bytes/s", "down/up_ratio", "a1b c"]
    got = [r[0] for r in spark.createDataFrame([(n,) for n in names], "n string").select(X.prettify(F.col("n"))).collect()]
    assert got == [n.replace("_", " ").title() for n in names]
    df = spark.createDataFrame([(-5e6, 2e6), (3.0, 1.0)], "a double, b double")
    assert FE.extreme_columns(df, ["a", "b"], threshold=1e6) == ["b"]


def test_name_flags_and_numeric_columns(spark):
    from flowlens.operators.clean import numeric_columns
    flags = {c: (t, i) for c, t, i in P.name_flags(["Flow Duration", "Timestamp", "Flow ID", "Idle Mean"])}
    assert flags["Timestamp"] == (True, False)
    assert flags["Flow ID"] == (False, True)
    assert flags["Idle Mean"] == (False, True)  # 'id' inside 'Idle' (reference behaviour)
    df = spark.createDataFrame([(1, 2.0, "x")], "a long, b double, c string")
    assert numeric_columns(df, exclude=["a"]) == ["b"]


def test_exact_quantiles_sketch_bracket_path(spark):
    df = _data(spark)
    vals = np.array([r["v"] for r in df.collect()])
    # accuracy 100 -> n (6000) >= 2 * accuracy: the approximate sketch brackets the ranks
    q = SC.exact_quantiles(df, ["v"], [0.1, 0.5, 0.9], bins=8, accuracy=100)
    assert np.allclose(q["v"], np.percentile(vals, [10, 50, 90]), rtol=0, atol=1e-12)


def test_hash_rank_digits_setting(spark):
    df = _data(spark)
    spark.conf.set("flowlens.rank.hashDigits", "1")
    try:
        got = {r["id"]: r["rank"] for r in W.hash_rank(df, ["g"], "id").collect()}
    finally:
        spark.conf.unset("flowlens.rank.hashDigits")
    w = Window.partitionBy("g").orderBy(F.md5(F.col("id").cast("string")), "id")
    ref = {r["id"]: r["r"] for r in df.select("id", F.row_number().over(w).alias("r")).collect()}
    assert got == ref


def test_running_sum_equal_depth_bounds(spark):
    df = _data(spark).groupBy("g", "v").agg(F.count(F.lit(1)).alias("c"))
    bounds = df.groupBy("g").agg(F.array_distinct(
        F.percentile_approx("v", [i / 8 for i in range(1, 8)], 1000)).alias("__bounds"))
    bounds = spark.createDataFrame(bounds.collect(), bounds.schema)
    for desc in (True, False):
        got = {(r["g"], r["v"]): r["c_cum"] for r in
               W.running_sum(df, ["g"], "v", ["c"], desc=desc, bounds=bounds).collect()}
        o = F.desc("v") if desc else F.asc("v")
        w = Window.partitionBy("g").orderBy(o).rowsBetween(Window.unboundedPreceding, 0)
        ref = {(r["g"], r["v"]): r["x"] for r in df.select("g", "v", F.sum("c").over(w).alias("x")).collect()}
        assert got == ref
