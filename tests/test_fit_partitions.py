"""Large tables in one partition are dealt out before a fit; small ones stay as they are."""

from flowlens.plans import q_stream as Q
from flowlens.plans import standins as S
from flowlens.streaming import score as SC


def test_no_partition_of_a_fit_is_too_large(spark, monkeypatch):
    df = spark.range(1000).coalesce(1)
    assert SC.spread_rows(df, ["id"]) is df
    parts = SC.spread_rows(df, ["id"], most=100).rdd.glom().map(len).collect()
    assert sum(parts) == 1000 and len(parts) == 10 and max(parts) < 200


def test_flow_model_is_fitted_on_dealt_rows(spark, monkeypatch):
    rows = [(i, i, i, 1, f"d{i % 7}", 0.1 * (i % 3), 1.0 * (i % 5), 2.0, 3.0 * (i % 2), 0.1, "AN"[i % 2], "O") for i in range(400)]
    names = [*S.LINE_KEY, "flow_duration", "total_fwd_packets", "total_backward_packets", "total_length_of_fwd_packets",
             "total_length_of_bwd_packets", "l_returnflag", "l_linestatus"]
    df = spark.createDataFrame([r[:10] + r[10:] for r in rows], names).coalesce(1)
    seen, pipeline = [], SC.flow_pipeline

    class Spy:
        def __init__(self, *a):
            self.inner = pipeline(*a, num_trees=2)

        def fit(self, lf):
            seen.append((lf.rdd.getNumPartitions(), lf.count()))
            return self.inner.fit(lf)

    monkeypatch.setattr(S, "line_flows", lambda spark, sf: df)
    monkeypatch.setattr(SC, "flow_pipeline", Spy)
    spread = SC.spread_rows
    monkeypatch.setattr(SC, "spread_rows", lambda d, key: spread(d, key, 100))
    Q.flow_model(spark, "made-up-for-this-test")
    assert seen == [(4, 400)]
