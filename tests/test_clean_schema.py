"""Inline-row tests for schema, cleaning and label operators (FIXTURES section 6)."""

import math

import pytest
from pyspark.sql import functions as F

from flowlens.operators import clean as C
from flowlens.operators import labels as L
from flowlens.sources import schema as S

INF = float("inf")
NAN = float("nan")


def test_sanitize_and_dedupe():
    assert S.sanitize_name("Flow Bytes/s") == "flow_bytes_per_s"
    assert S.sanitize_name("Fwd Header Length.1") == "fwd_header_length_1"
    assert S.sanitize_name("Down/Up Ratio") == "down_up_ratio"
    assert S.dedupe_headers(["a", "b", "a", "a"]) == ["a", "b", "a.1", "a.2"]
    assert len(S.FLOW_COLUMNS) == 70 and len(set(S.FLOW_COLUMNS)) == 70


def test_repeated_csv_header(spark, tmp_path):
    p = tmp_path / "flows.csv"
    p.write_text("Fwd Header Length,Flow Bytes/s,Fwd Header Length,Label\n"
                 "1,Infinity,2, BENIGN\n3,NaN,4,DDoS\n")
    df = S.read_flow_csv(spark, str(p))
    typed = df.select(*[F.col(c).cast("double") for c in df.columns[:3]])
    rows = typed.collect()
    assert rows[0][1] == INF and math.isnan(rows[1][1]) and rows[1][2] == 4.0


def test_csv_columns_bind_by_name(spark, tmp_path):
    p = tmp_path / "flows.csv"
    p.write_text("Label,Extra,Total Fwd Packets,flow duration\nDDoS,7,2,1.5\n")
    out = S.align_names(S.read_flow_csv(spark, str(p)), ["Flow Duration", "Total Fwd Packets"], keys=["label"])
    assert out.first().asDict() == {"label": "DDoS", "flow_duration": 1.5, "total_fwd_packets": 2.0}
    with pytest.raises(ValueError, match="missing"):
        S.check_contract(S.read_flow_csv(spark, str(p)))


def test_contract_missing_column(spark):
    df = spark.createDataFrame([(1.0,)], "flow_duration double")
    with pytest.raises(ValueError, match="missing"):
        S.check_contract(df, ["flow_duration", "total_fwd_packets"])
    assert S.check_contract(df, ["flow_duration"]) is df


def test_align_names_case_spaces_missing_extra(spark):
    df = spark.createDataFrame([(1, 2.0, 3.0, 9.0)], "id long, FLOW_DURATION double, `total fwd packets` double, extra double")
    out = S.align_names(df, ["Destination Port", "Flow Duration", "Total Fwd Packets"], keys=["id"])
    assert out.columns == ["id", "destination_port", "flow_duration", "total_fwd_packets"]
    assert out.first().asDict() == {"id": 1, "destination_port": 0.0, "flow_duration": 2.0,
                                    "total_fwd_packets": 3.0}


def test_clean_fill_drop_sentinel(spark):
    df = spark.createDataFrame([(1, INF, 1.0, -1.0), (2, NAN, 2.0, 5.0), (3, None, 3.0, -1.0),
                                (4, 4.0, -INF, 0.0), (5, 5.0, 5.0, 7.0)],
                               "id long, a double, b double, w double")
    filled = {r["id"]: (r["a"], r["b"]) for r in C.clean_fill(df, ["a", "b"]).collect()}
    assert filled[1] == (0.0, 1.0) and filled[2] == (0.0, 2.0) and filled[3] == (0.0, 3.0)
    assert filled[4] == (4.0, 0.0)
    assert [r["id"] for r in C.clean_drop(df, ["a", "b"]).collect()] == [5]
    rep = {r["id"]: r["w"] for r in C.replace_sentinel(df, ["w", "not_there"]).collect()}
    assert rep == {1: 0.0, 2: 5.0, 3: 0.0, 4: 0.0, 5: 7.0}


def test_rates_zero_duration_and_clamp(spark):
    df = spark.createDataFrame([(0.0, 10.0, 5.0, 2.0, 1.0), (2.0, 10.0, 6.0, 3.0, 1.0)],
                               "d double, fb double, bb double, fp double, bp double")
    r = C.flow_rates(df, "d", "fb", "bb", "fp", "bp").collect()
    assert (r[0]["flow_bytes_per_s"], r[0]["flow_packets_per_s"]) == (0.0, 0.0)
    assert (r[1]["flow_bytes_per_s"], r[1]["flow_packets_per_s"]) == (8.0, 2.0)
    c = spark.createDataFrame([(-2.7, -0.5), (3.9, 1.5)], "n double, x double")
    out = C.clamp_non_negative(c, ["n"], ["x"]).collect()
    assert (out[0]["n"], out[0]["x"]) == (0, 0.0) and (out[1]["n"], out[1]["x"]) == (3, 1.5)


def test_default_rule_first_match_wins():
    assert C.default_for_name("SYN Flag Count") == 0.0
    assert C.default_for_name("Packet Length Mean") == 10.0
    assert C.default_for_name("Max Packet Length") == 1000.0
    assert C.default_for_name("Min Packet Length") == 0.0
    assert C.default_for_name("Total Length of Bwd Packets") == 1000.0
    assert C.default_for_name("Fwd Packets/s") == 100.0
    assert C.default_for_name("Destination Port") == 0.0
    d = C.benign_defaults()
    assert d["Flow Duration"] == 5.5 and d["Flow Packets/s"] == 4.0


def test_labels_trim_regroup_exclude(spark):
    df = spark.createDataFrame([(" BENIGN ",), ("Web Attack - XSS",), ("DoS Hulk",), ("SSH-Patator",),
                                ("Bot",), (None,), ("PortScan",)], "label string")
    g = L.regroup_labels(df, "label", out="g")
    got = [r["g"] for r in g.collect()]
    assert got == ["BENIGN", "Web_Attacks", "DoS_Attacks", "Patator_Attacks", "Bot", None, "PortScan"]
    kept = [r["g"] for r in L.exclude_classes(g, "g").collect()]
    assert kept == ["BENIGN", "Web_Attacks", "DoS_Attacks", None, "PortScan"]
    rc = L.removed_count(g, "g").first()
    assert (rc["rows_before"], rc["rows_after"], rc["rows_removed"]) == (7, 5, 2)
    with pytest.raises(ValueError):
        L.check_class_count(g.where("g = 'BENIGN'"), "g")


def test_fixed_weights_unmatched_raises(spark):
    df = spark.createDataFrame([(0,), (3,)], "code int")
    assert [r["weight"] for r in L.fixed_weights(df, "code").collect()] == [0.64, 0.06]
    with pytest.raises(Exception):
        L.fixed_weights(spark.createDataFrame([(9,)], "code int"), "code").collect()


def test_pad_results_fill(spark):
    a = spark.createDataFrame([(1.5, "Attack")], "f double, `M1_Prediction` string")
    b = spark.createDataFrame([(2.5, 0.25, "x")], "f double, `M2_AttackProb` double, other string")
    out = C.pad_results([a, b], ["f"], ["M1_Prediction", "M2_AttackProb"])
    assert out.columns == ["f", "M1_Prediction", "M2_AttackProb", "other"]
    rows = sorted(tuple(r) for r in out.collect())
    assert rows == [("1.5", "Attack", "N/A", "N/A"), ("2.5", "N/A", "0.25", "x")]


def test_unmatched_weight_codes_reported(spark):
    df = spark.createDataFrame([(0,), (3,), (7,), (7,)], "code int")
    out = {r["code"]: r["n_rows"] for r in L.unmatched_weight_codes(df, "code").collect()}
    assert out == {7: 2}


def test_pad_results_keep_nulls_form(spark):
    a = spark.createDataFrame([(1.5, "Attack")], "f double, `M1_Prediction` string")
    b = spark.createDataFrame([(2.5, 0.25)], "f double, `M2_AttackProb` double")
    out = C.pad_results([a, b], ["f"], ["M1_Prediction", "M2_AttackProb"], fill=None)
    rows = sorted(out.collect(), key=lambda r: r["f"])
    assert rows[0]["M2_AttackProb"] is None and rows[1]["M2_AttackProb"] == 0.25


def test_csv_folder_with_several_headers(spark, tmp_path):
    """Every file is read by its own header; blanks and signs in its path are no trouble."""
    folder = tmp_path / "day 1+2%"
    folder.mkdir()
    (folder / "a b.csv").write_text("Total Fwd Packets,Label,Flow Bytes/s\n1,DDoS,10\n2,BENIGN,Infinity\n")
    (folder / "b.csv").write_text("Label,Flow Bytes/s,Total Fwd Packets\nBot,30,3\n")
    (folder / "c+d.csv").write_text("Label,Total Fwd Packets\nPortScan,4\n")
    (folder / "e.csv").write_text("Total Fwd Packets,Label,Flow Bytes/s\n5,DDoS,50\n")
    (folder / "f.csv").write_text("")
    df = S.read_flow_csv(spark, str(folder))
    assert df.columns == ["total_fwd_packets", "label", "flow_bytes_per_s"]
    got = sorted(tuple(r) for r in df.collect())
    assert got == [(1.0, "DDoS", 10.0), (2.0, "BENIGN", INF), (3.0, "Bot", 30.0), (4.0, "PortScan", None),
                   (5.0, "DDoS", 50.0)]
