"""Verdict, consensus and evaluation properties."""

import pytest
from pyspark.sql import functions as F

from flowlens.operators import evaluate as E
from flowlens.operators import sample as R
from flowlens.operators import verdict as V


def test_attack_cascade_and_names(spark):
    df = spark.createDataFrame([(0.9, 0.1), (0.45, 0.55), (0.3, 0.7), (0.1, 0.9)],
                               "benign_prob double, attack_prob double")
    out = V.verdict(df, "benign_prob", "attack_prob", V.attack_dim(spark)).orderBy("attack_prob").collect()
    assert [r["attack_code"] for r in out] == ["benign", "probe", "dos", "web"]
    assert [r["attack_type"] for r in out] == ["N/A", "Probing/Scanning", "Denial of Service (DoS)", "Web Attack"]
    t = V.verdict_text(V.verdict(df, "benign_prob", "attack_prob"), F.lit("M")).orderBy("attack_prob").collect()
    assert t[0]["confidence"] == "90.00%" and t[3]["confidence"] == "90.00%"
    assert t[0]["characteristics"] is None and t[1]["characteristics"].startswith("Often involves scanning")
    adv = V.advice(V.verdict(df, "benign_prob", "attack_prob"), ["attack_prob"])
    assert adv.count() == 1 + 3 * 5


def test_consensus_tie_error_missing(spark):
    rows = spark.createDataFrame([(1,), (2,), (3,)], "row_id long")
    ok = F.lit("ok")
    m1 = spark.createDataFrame([(1, 0.2), (2, 0.9), (3, 0.9)], "row_id long, attack_prob double")
    m2 = spark.createDataFrame([(1, 0.9), (2, 0.1), (3, 0.9)], "row_id long, attack_prob double")
    m3 = spark.createDataFrame([(1, None), (2, 0.2), (3, None)], "row_id long, attack_prob double")
    scored = {"A": m1.withColumn("status", ok), "B": m2.withColumn("status", ok),
              "C": m3.withColumn("status", F.when(F.col("attack_prob").isNull(), "error").otherwise("ok"))}
    scored = {k: v.withColumn("benign_prob", 1 - F.col("attack_prob")) for k, v in scored.items()}
    votes = V.model_votes(rows, "row_id", scored, ["A", "B", "C", "D"])
    assert votes.count() == 12
    c = {r["row_id"]: r for r in V.consensus(votes, "row_id").collect()}
    # row 1: A Benign, B Attack, C Error -> tie, first model (A) wins
    assert c[1]["majority_prediction"] == "Benign" and c[1]["valid_count"] == 2
    assert c[1]["consensus_level"] == 50.0
    assert c[2]["majority_prediction"] == "Benign" and c[2]["majority_count"] == 2
    assert c[3]["majority_prediction"] == "Attack" and c[3]["consensus_level"] == 100.0
    err = {r["row_id"]: (r["has_error"], r["n_error"], r["n_missing"]) for r in
           V.vote_errors(votes, "row_id").collect()}
    assert err[1] == (True, 1, 1) and err[2] == (False, 0, 1)


def _pred_table(spark):
    rows = [("a", "a")] * 5 + [("a", "b")] * 2 + [("b", "b")] * 3 + [("b", "c")] + [("c", "a")] * 2
    return spark.createDataFrame(rows, "t string, p string")


def test_confusion_properties(spark):
    df = _pred_table(spark)
    cm = E.confusion_matrix(df, "t", "p")
    assert cm.count() == 9 and cm.agg(F.sum("n")).first()[0] == df.count()
    m = E.summary_metrics(df, "t", "p").first()
    assert m["accuracy"] == m["recall"]  # weighted recall equals accuracy
    assert -1 <= m["matthews_corrcoef"] <= 1
    rep = {r["class"]: r for r in E.class_report(df, "t", "p").collect()}
    assert rep["c"]["support"] == 2 and rep["c"]["precision"] == 0.0
    assert rep["accuracy"]["f1_score"] == round(8 / 13, 6)


def test_roc_ties_and_missing_positives(spark):
    rows = [("x", 0.9), ("x", 0.9), ("y", 0.9), ("y", 0.1), ("x", 0.5)]
    df = spark.createDataFrame(rows, "t string, s double")
    long = E.one_vs_rest(df, "t", {"x": "s", "z": "s"})
    roc = E.roc_points(long).where("class = 'x'").orderBy(F.desc_nulls_first("threshold")).collect()
    # tied scores collapse into one point
    assert [(r["fpr"], r["tpr"]) for r in roc] == [(0.0, 0.0), (0.5, round(2 / 3, 6)), (0.5, 1.0), (1.0, 1.0)]
    auc = {r["class"]: r["auc"] for r in E.auc(long).collect()}
    assert 0 <= auc["x"] <= 1 and auc["z"] is None
    z = E.roc_points(long).where("class = 'z' AND threshold IS NOT NULL").collect()
    assert all(r["tpr"] is None for r in z)


def test_folds_partition_rows(spark):
    df = spark.range(0, 500).withColumn("label", (F.col("id") % 3).cast("string"))
    f = R.stratified_folds(df, "label", "id", k=5)
    assert f.count() == 500 and f.select("id").distinct().count() == 500
    sizes = [r["count"] for r in f.groupBy("label", "fold").count().collect()]
    assert max(sizes) - min(sizes) <= 1
    s = R.stratified_split(df, "label", "id")
    assert s.where("split = 'test'").count() == sum(round(c * 0.2) for c in (167, 167, 166))


def test_profile_match_tie_goes_to_first_class(spark):
    df = spark.createDataFrame([(1, 5.0, 10.0, 10.0)], "id long, d double, f double, b double")
    out = V.profile_match(df, ["id"], {"Flow Duration": "d", "Total Fwd Packets": "f",
                                       "Total Backward Packets": "b"}).first()
    assert out["match_benign"] == 3 and out["best_class"] == "Benign"


def test_fixed_sample_bounded(spark):
    df = spark.range(0, 50).withColumn("label", F.lit("a"))
    assert R.fixed_sample(df, "id", 100).count() == 50


def test_kde_integrates_to_about_one(spark):
    rows = [("a", i / 100.0) for i in range(20, 80)]
    df = spark.createDataFrame(rows, "t string, s double")
    k = E.score_kde(df, "t", "s", points=201).collect()
    area = sum(r["density"] for r in k) * (1 / 200)
    assert area == pytest.approx(1.0, abs=0.05)


def test_wide_votes_equal_union_votes(spark):
    from flowlens.plans import q_verdict as QV
    from tests.conftest import SF001
    rows, scored = QV.doc_models(spark, SF001)
    a = V.model_votes(rows, "doc_id", scored, QV.SELECTED)
    b = QV.votes(spark, SF001)
    cols = sorted(a.columns)
    assert sorted((tuple(r) for r in a.select(*cols).collect()), key=repr) == \
        sorted((tuple(r) for r in b.select(*cols).collect()), key=repr)


def test_degenerate_inputs_do_not_raise(spark):
    one = spark.createDataFrame([("a", 0.5), ("a", 0.5)], "t string, s double")
    k = E.score_kde(one, "t", "s").collect()
    assert len(k) == 51 and all(r["density"] is None for r in k)
    empty = spark.createDataFrame([], "t string, p string")
    m = E.summary_metrics(empty, "t", "p").first()
    assert m is None or m["accuracy"] is None
