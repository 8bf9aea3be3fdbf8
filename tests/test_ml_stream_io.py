"""ML properties (Shapley additivity, SMOTE betweenness), streaming twins and sinks."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from flowlens.operators import ensemble as M
from flowlens.operators import explain as X
from flowlens.operators import smote as SM
from flowlens.sources import sinks as K
from flowlens.streaming import flows as FL
from tests.conftest import SF001


def _toy(spark, n=120):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(n):
        lab = i % 2
        v = (rng.normal(size=4) + lab * 1.5).tolist()
        rows.append((i, float(lab), v))
    return spark.createDataFrame(rows, "id long, label double, arr array<double>")


def test_shapley_values_add_up(spark):
    df = M.with_features(_toy(spark), "arr")
    model = M.forest(num_trees=5, max_depth=3).fit(df)
    names = ["f0", "f1", "f2", "f3"]
    bg = X.kmeans_background(df, k=3)
    few = df.where("id < 6")
    vals = X.shapley(few, "id", "arr", model, bg, names, class_index=1, permutations=3)
    per = vals.groupBy("id").agg(F.sum("shap_value").alias("s"), F.first("base_value").alias("b"),
                                 F.first("prediction").alias("p")).collect()
    for r in per:
        assert r["s"] == pytest.approx(r["p"] - r["b"], abs=1e-9)
    top = X.top_attributions(vals, "id", 2)
    assert top.groupBy("id").count().agg(F.max("count")).first()[0] == 2


def test_local_surrogate_shape(spark):
    df = M.with_features(_toy(spark), "arr")
    model = M.forest(num_trees=5, max_depth=3).fit(df)
    out = X.local_surrogate(df.where("id < 4"), "id", "arr", model, [0.0] * 4, [1.0] * 4,
                            ["f0", "f1", "f2", "f3"], samples=30, top=3)
    assert out.count() == 4 * 3
    assert set(r["rank"] for r in out.collect()) == {1, 2, 3}


def test_smote_points_between_same_class_rows(spark):
    base = _toy(spark, 40).where("label = 1 OR id < 10")  # class 0 is the minority
    out = SM.smote(base, "id", "label", "arr")
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts[0.0] == counts[1.0]
    src = {r["id"]: np.array(r["arr"]) for r in base.collect()}
    labels = {r["id"]: r["label"] for r in base.collect()}
    for r in out.where("copy >= 0").collect():
        p = np.array(r["arr"])
        a = src[r["id"]]
        ok = any(labels[j] == r["label"] and _between(p, a, b) for j, b in src.items())
        assert ok


def test_smote_neighbours_exact_with_small_buckets(spark, monkeypatch):
    """Tiles cut into rings and blocks (as on a large class) keep the neighbours exact."""
    monkeypatch.setattr(SM, "TILE_ROWS", 7)
    monkeypatch.setattr(SM, "PIVOT_BYTES", 8 * 6 * 8)
    test_smote_neighbours_exact_against_brute_force(spark)


def test_smote_neighbours_prune_clusters(spark, monkeypatch):
    """On clustered points far fewer pairs than all pairs of the class are compared, and rows
    that cannot take part (no label, null, non-finite or short vectors) are left out."""
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(40, 8)) * 100
    rows = [(i, 1, (centres[i % 40] + rng.normal(size=8)).tolist()) for i in range(1600)]
    bad = [(2000, None, [0.0] * 8), (2001, 1, None), (2002, 1, [float("nan")] * 8), (2003, 1, [1.0])]
    df = spark.createDataFrame(rows + bad, "id long, label int, arr array<double>")
    pairs, run = [], SM.nearest_in_rings

    def counted(ask, index, sizes, k):
        met = ask.groupBy(*SM.RING).count().join(sizes, SM.RING)
        pairs.append(met.selectExpr("coalesce(sum(count * n), 0) s").first().s)
        return run(ask, index, sizes, k)
    monkeypatch.setattr(SM, "nearest_in_rings", counted)
    got = SM.same_class_neighbours(df, "id", "label", "arr").collect()
    assert len(got) == 1600 and sum(pairs) < 1600 * 1600 / 8
    x = np.array([r[2] for r in rows])
    at = {tuple(v): i for i, v in enumerate(x.tolist())}
    for r in got[::40]:
        d = np.sqrt(((x - np.array(r["__arr"])) ** 2).sum(axis=1))
        d[at[tuple(r["__arr"])]] = np.inf
        assert [e["q"] for e in r["nbrs"]] == np.argsort(d, kind="stable")[:5].tolist()


def test_smote_neighbours_exact_against_brute_force(spark):
    """The k nearest other rows of the same class equal a numpy brute force, with exact
    duplicates (own copies come first at distance 0) and a class smaller than k."""
    rng = np.random.default_rng(11)
    rows = []
    for i in range(300):
        lab = i % 3
        v = (rng.normal(size=6) * (1 + lab)).round(3)
        rows.append((i, lab, v.tolist()))
    for i in range(300, 340):  # 40 copies of one point of class 0
        rows.append((i, 0, rows[0][2]))
    rows += [(400, 7, [0.0] * 6), (401, 7, [1.0] * 6), (402, 7, [0.0] * 6)]
    df = spark.createDataFrame(rows, "id long, label int, arr array<double>")
    nb = SM.same_class_neighbours(df, "id", "label", "arr", k=5).collect()
    got = {(r["label"], tuple(r["__arr"])): r for r in nb}
    by_class = {}
    for i, lab, v in rows:
        by_class.setdefault(lab, []).append((i, np.array(v)))
    for (lab, arr), r in got.items():
        a = np.array(arr)
        members = by_class[lab]
        own = [i for i, v in members if np.array_equal(v, a)]
        others = sorted((float(np.linalg.norm(v - a)), i) for i, v in members
                        if not np.array_equal(v, a))
        expect = [0.0] * min(len(own) - 1, 5) + [d for d, _ in others][:max(0, 5 - (len(own) - 1))]
        seen = []
        prev = 0
        for e in r["nbrs"]:
            seen += [e["d"]] * (e["cum_end"] - prev)
            prev = e["cum_end"]
        assert r["__total"] == len(expect)
        assert seen == pytest.approx(expect, abs=1e-9)


def _between(p, a, b):
    d = b - a
    if np.allclose(d, 0):
        return np.allclose(p, a)
    u = np.dot(p - a, d) / np.dot(d, d)
    return -1e-9 <= u <= 1 + 1e-9 and np.allclose(a + u * d, p, atol=1e-9)


def test_smote_single_row_class_is_repeated(spark):
    rows = [(0, 0.0, [0.0, 0.0]), (1, 1.0, [1.0, 1.0]), (2, 1.0, [1.1, 1.0]), (3, 1.0, [1.0, 1.2])]
    df = spark.createDataFrame(rows, "id long, label double, arr array<double>")
    out = SM.smote(df, "id", "label", "arr")
    synth = out.where("label = 0 AND copy >= 0").collect()
    assert len(synth) == 2 and all(r["arr"] == [0.0, 0.0] for r in synth)


def test_stream_flows_equal_batch(spark, tmp_path):
    batch = FL.packets_to_flows(FL.packet_records(FL.events_as_packets(
        spark.read.parquet(f"{SF001}/events.parquet"))), 6 * 3600)
    stream = FL.stream_flows(FL.packet_stream(spark, SF001), gap="6 hours", watermark="1 day")
    q = (stream.writeStream.format("memory").queryName("flows_twin").outputMode("complete")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("flows_twin").drop("__session")
    cols = sorted(batch.columns)
    a = sorted(tuple(r) for r in batch.select(*cols).collect())
    b = sorted(tuple(r) for r in got.select(*cols).collect())
    assert a == b


def test_latest_n_foreach_batch(spark, tmp_path):
    state = str(tmp_path / "latest")
    src = FL.packet_stream(spark, SF001)
    q = (src.writeStream.foreachBatch(FL.latest_n_sink(state, 50))
         .option("checkpointLocation", str(tmp_path / "ck2")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = FL.read_latest(spark, state)
    ref = FL.latest_n(FL.packet_records(FL.events_as_packets(
        spark.read.parquet(f"{SF001}/events.parquet"))), 50)
    assert sorted(r["packet_id"] for r in got.collect()) == sorted(r["packet_id"] for r in ref.collect())


def test_stream_scoring_and_registry(spark, tmp_path):
    from flowlens.plans import standins as S
    from flowlens.streaming import score as SC
    lf = S.line_flows(spark, SF001)
    model = SC.with_label_text(SC.flow_pipeline(SC.SCORE_FEATURES, "l_returnflag", num_trees=3).fit(lf))
    root = str(tmp_path / "models")
    K.save_model(model, f"{root}/random_forest")
    models, reg = K.load_registry(spark, root, ["GBM", "Random Forest"])
    status = {r["model"]: r["status"] for r in reg.collect()}
    assert status == {"GBM": "missing", "Random Forest": "loaded"}
    with pytest.raises(RuntimeError):
        K.load_registry(spark, str(tmp_path / "none"), ["GBM"])
    q = SC.start_flow_scoring(spark, SF001, models["Random Forest"], str(tmp_path / "out"),
                              str(tmp_path / "ck3"), trigger={"availableNow": True})
    q.awaitTermination(300)
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() > 0 and set(r["predicted_class"] for r in out.collect()) <= {"A", "N", "R"}


def test_sinks_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([(1, "Attack")], "row_id long, prediction string")
    p = str(tmp_path / "res")
    K.write_results(df, p)
    back = spark.read.option("header", True).csv(p)
    assert back.columns == ["row_id", "prediction"] and back.count() == 1
    a = spark.createDataFrame([("X", 0.9, 0.8)], "Model string, Accuracy double, `F1 Score` double")
    b = spark.createDataFrame([("Y", 0.7, 0.1)], "model_name string, accuracy double, MCC double")
    m = K.canonical_metrics([a, b])
    assert m.columns == [f.name for f in K.METRICS_SCHEMA]
    rows = {r["model"]: r for r in m.collect()}
    assert rows["X"]["f1_score"] == 0.8 and rows["Y"]["matthews_corrcoef"] == 0.1


def test_train_and_classify_workflow(spark, tmp_path):
    from flowlens import workflows as W
    from flowlens.plans import standins as S
    from flowlens.streaming.score import SCORE_FEATURES
    flows = S.line_flows(spark, SF001).withColumn("flow_id", F.concat_ws("|", *S.LINE_KEY))
    root = str(tmp_path / "models")
    _, metrics = W.train_models(flows, "flow_id", "l_returnflag", SCORE_FEATURES, benign="N",
                                substring_rules=[], mapping={}, excluded=[], save_root=root,
                                small=True)
    assert [r["model"] for r in metrics.collect()] == ["Random Forest", "GBM"]
    models, reg = K.load_registry(spark, root, ["GBM", "Random Forest", "XGBoost"])
    assert {r["model"]: r["status"] for r in reg.collect()}["XGBoost"] == "missing"
    votes, cons = W.classify_flows(flows, "flow_id", SCORE_FEATURES, models,
                                   ["Random Forest", "GBM", "XGBoost"])
    n = flows.count()
    assert cons.count() == n and votes.count() == 3 * n
    assert votes.where("model = 'XGBoost'").select("prediction").distinct().first()[0] == "Missing"
    assert cons.where("valid_count != 2").count() == 0


def test_cli_train_and_classify(spark, tmp_path):
    """S1 + lifecycle B + S8/S9 + lifecycle A through the command line."""
    from flowlens.__main__ import main
    from flowlens.functions.fixed import FLOW_FEATURES
    rng = np.random.default_rng(11)
    header = [("Fwd Header Length" if n == "Fwd Header Length.1" else n) for n in FLOW_FEATURES]
    lines = [",".join(header + ["Label"])]
    labels = [" BENIGN", "DoS Hulk", "PortScan", "Web Attack - XSS", "Bot"]
    for i in range(200):
        lab = labels[i % len(labels)]
        vals = rng.normal(size=70) + (i % len(labels))
        cells = [f"{v:.4f}" for v in vals]
        if i % 17 == 0:
            cells[14] = "Infinity"
        if i % 19 == 0:
            cells[15] = "NaN"
        lines.append(",".join(cells + [lab]))
    csv = tmp_path / "flows.csv"
    csv.write_text("\n".join(lines) + "\n")
    models = str(tmp_path / "models")
    assert main(["train", "--csv", str(csv), "--models", models, "--small"]) == 0
    out = str(tmp_path / "verdicts")
    res = str(tmp_path / "results_csv")
    assert main(["classify", "--csv", str(csv), "--models", models, "--out", out,
                 "--results-csv", res]) == 0
    cons = spark.read.parquet(out)
    assert cons.count() == 200
    table = spark.read.option("header", True).csv(res)
    assert table.columns[:2] == ["destination_port", "flow_duration"]
    assert table.columns[70:74] == ["GBM_AttackProb", "GBM_Prediction",
                                    "Random Forest_AttackProb", "Random Forest_Prediction"]
    assert table.columns[-1] == "flow_id" and table.count() == 200
    assert set(r[0] for r in cons.select("majority_prediction").distinct().collect()) <= {"Attack", "Benign"}


def test_packet_times_do_not_depend_on_session_time_zone(spark):
    ev = spark.read.parquet(f"{SF001}/events.parquet")
    old = spark.conf.get("spark.sql.session.timeZone")
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/Los_Angeles")
        la = FL.packets_to_flows(FL.packet_records(FL.events_as_packets(ev))).collect()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    utc = FL.packets_to_flows(FL.packet_records(FL.events_as_packets(ev))).collect()
    assert sorted(map(tuple, la), key=repr) == sorted(map(tuple, utc), key=repr)


def test_json_packet_records_stream(spark, tmp_path):
    """S10 + ST1: JSON packet lines as a stream; malformed records and records without a
    timestamp are skipped; absent fields fall back; nested features are kept."""
    d = tmp_path / "packets"
    d.mkdir()
    (d / "p1.json").write_text("\n".join([
        '{"timestamp": 10.5, "source": "a", "destination": "b", "protocol": 6, "length": 60, '
        '"features": {"flow_duration": 1.0, "tot_fwd_pkts": 2.0}}',
        '{"timestamp": 11.0, "source": "b", "length": 40}',
        'not json at all',
        '{"source": "x", "destination": "y"}',
    ]) + "\n")
    raw = spark.readStream.format("text").load(str(d))
    parsed = FL.parse_packets(raw, "value")
    q = (parsed.writeStream.format("memory").queryName("json_packets")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(120)
    rows = sorted(spark.table("json_packets").collect(), key=lambda r: r["ts_us"])
    assert [r["ts_us"] for r in rows] == [10_500_000, 11_000_000]
    assert rows[1]["destination"] == "" and rows[1]["protocol"] == 0
    assert rows[0]["features"]["tot_fwd_pkts"] == 2.0 and rows[0]["src_a"] == "a"


def test_smote_to_rebalance_plan(spark):
    from flowlens.operators import sample as R
    base = _toy(spark, 40).where("label = 1 OR id < 10")  # 5 vs 20 rows: n/k = 12.5
    out = SM.smote(base, "id", "label", "arr", plan=R.rebalance_plan(base, "label"))
    counts = {r["label"]: r["count"] for r in out.groupBy("label").count().collect()}
    assert counts == {0.0: 12, 1.0: 20}


def test_cli_list_and_query(spark, tmp_path, capsys):
    from flowlens.__main__ import main
    assert main(["list"]) == 0
    listed = capsys.readouterr().out
    assert "consensus (oracle)" in listed and "smote (rows)" in listed
    out = str(tmp_path / "q")
    assert main(["query", "class_distribution", "--sf", SF001, "--out", out]) == 0
    assert spark.read.parquet(out).count() == 3


def test_flows_do_not_depend_on_bucket_width(spark):
    p = FL.packet_records(FL.events_as_packets(spark.read.parquet(f"{SF001}/events.parquet")))
    day = FL.packets_to_flows(p, 6 * 3600, bucket_seconds=86400).collect()
    hour = FL.packets_to_flows(p, 6 * 3600, bucket_seconds=3600).collect()
    assert sorted(map(tuple, day), key=repr) == sorted(map(tuple, hour), key=repr)


def test_stream_append_mode_emits_closed_flows_only(spark, tmp_path):
    batch = FL.packets_to_flows(FL.packet_records(FL.events_as_packets(
        spark.read.parquet(f"{SF001}/events.parquet"))), 6 * 3600)
    stream = FL.stream_flows(FL.packet_stream(spark, SF001), gap="6 hours", watermark="1 hour")
    q = (stream.writeStream.format("memory").queryName("flows_append").outputMode("append")
         .option("checkpointLocation", str(tmp_path / "ck")).trigger(availableNow=True).start())
    q.awaitTermination(300)
    got = spark.table("flows_append").drop("__session")
    cols = sorted(batch.columns)
    b = set(tuple(r) for r in batch.select(*cols).collect())
    a = [tuple(r) for r in got.select(*cols).collect()]
    assert a and set(a) <= b           # every emitted flow is final and equals its batch twin
    assert len(a) < len(b)             # flows still open at the end are held back


def test_smote_of_empty_and_unlabelled_tables(spark):
    """No rows give no rows; rows without a label or vector are kept and never copied from."""
    schema = "id long, label double, arr array<double>"
    assert SM.smote(spark.createDataFrame([], schema), "id", "label", "arr").count() == 0
    rows = [(1, None, [0.0]), (2, 1.0, None), (3, 1.0, [1.0]), (4, 1.0, [2.0]), (5, 0.0, None)]
    got = SM.smote(spark.createDataFrame(rows, schema), "id", "label", "arr").collect()
    assert sorted(r.id for r in got if r.copy < 0) == [1, 2, 3, 4, 5]
    assert [(r.id, r.arr) for r in got if r.copy >= 0] == [(5, None), (5, None)]
