"""Packet-stream queries, batch twins of the streaming operators (ST1-ST3, K5)."""

from __future__ import annotations

from flowlens.plans.registry import register
from flowlens.sources.tables import table
from flowlens.streaming import flows as FL

GAP_SECONDS = 6 * 3600

_RECORDS_SQL = """
SELECT packet_id, ts_us, source, destination, protocol, length, window_size,
       least(source, destination) AS src_a, greatest(source, destination) AS dst_b
FROM (SELECT event_id AS packet_id, epoch_us(ts) AS ts_us,
        CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'user-' || CAST(user_id AS VARCHAR)
             ELSE 'server' END AS source,
        CASE WHEN event_type IN ('view', 'click', 'signup') THEN 'server'
             ELSE 'user-' || CAST(user_id AS VARCHAR) END AS destination,
        6 AS protocol, CAST(round(value * 100) AS BIGINT) AS length,
        (event_id % 64) * 1024 AS window_size
      FROM events)
WHERE ts_us IS NOT NULL
"""


def packets(spark, sf):
    return FL.packet_records(FL.events_as_packets(table(spark, sf, "events")))


@register("packet_records", _RECORDS_SQL)
def packet_records(spark, sf):
    return packets(spark, sf)


@register("latest_50", f"SELECT * FROM ({_RECORDS_SQL}) ORDER BY ts_us DESC, packet_id DESC LIMIT 50")
def latest_50(spark, sf):
    return FL.latest_n(packets(spark, sf), 50)


def _pick(a, b):
    return f"CASE WHEN fwd_src = src_a THEN {a} ELSE {b} END"


_FLOWS_SQL = f"""
WITH r AS ({_RECORDS_SQL}),
t AS (SELECT DISTINCT src_a, dst_b, protocol, ts_us FROM r),
l AS (SELECT *, lag(ts_us) OVER (PARTITION BY src_a, dst_b, protocol ORDER BY ts_us) AS prev FROM t),
s AS (SELECT src_a, dst_b, protocol, ts_us,
        sum(CASE WHEN prev IS NULL OR ts_us - prev > {int(GAP_SECONDS * 1e6)} THEN 1 ELSE 0 END)
          OVER (PARTITION BY src_a, dst_b, protocol ORDER BY ts_us ROWS UNBOUNDED PRECEDING) AS session_no
      FROM l),
j AS (SELECT r.*, s.session_no FROM r JOIN s USING (src_a, dst_b, protocol, ts_us)),
g AS (SELECT src_a, dst_b, protocol, session_no, min(ts_us) AS t0, max(ts_us) AS t1,
        arg_min(source, {{'t': ts_us, 'i': packet_id}}) AS fwd_src,
        count(*) FILTER (WHERE source = src_a) AS n_a,
        count(*) FILTER (WHERE source = dst_b AND src_a <> dst_b) AS n_b,
        CAST(sum(length) FILTER (WHERE source = src_a) AS BIGINT) AS bytes_a,
        CAST(sum(length) FILTER (WHERE source = dst_b AND src_a <> dst_b) AS BIGINT) AS bytes_b,
        avg(length) FILTER (WHERE source = src_a) AS mean_a,
        avg(length) FILTER (WHERE source = dst_b AND src_a <> dst_b) AS mean_b,
        arg_min(window_size, {{'t': ts_us, 'i': packet_id}}) FILTER (WHERE source = src_a) AS win_a,
        arg_min(window_size, {{'t': ts_us, 'i': packet_id}}) FILTER (WHERE source = dst_b AND src_a <> dst_b) AS win_b
      FROM j GROUP BY src_a, dst_b, protocol, session_no),
f AS (SELECT src_a, dst_b, protocol, make_timestamp(t0) AS session_start,
        (t1 - t0) / 1e6 AS flow_duration,
        {_pick('n_a', 'n_b')} AS total_fwd_packets, {_pick('n_b', 'n_a')} AS total_backward_packets,
        CAST(coalesce({_pick('bytes_a', 'bytes_b')}, 0) AS BIGINT) AS total_length_of_fwd_packets,
        CAST(coalesce({_pick('bytes_b', 'bytes_a')}, 0) AS BIGINT) AS total_length_of_bwd_packets,
        coalesce({_pick('mean_a', 'mean_b')}, 0.0) AS fwd_packet_length_mean,
        coalesce({_pick('mean_b', 'mean_a')}, 0.0) AS bwd_packet_length_mean,
        CAST(coalesce({_pick('win_a', 'win_b')}, 0) AS BIGINT) AS init_win_bytes_forward,
        CAST(coalesce({_pick('win_b', 'win_a')}, 0) AS BIGINT) AS init_win_bytes_backward
      FROM g)
SELECT *,
  CASE WHEN flow_duration = 0 THEN 0.0
       ELSE CAST(total_length_of_fwd_packets + total_length_of_bwd_packets AS DOUBLE) / flow_duration END
    AS flow_bytes_per_s,
  CASE WHEN flow_duration = 0 THEN 0.0
       ELSE CAST(total_fwd_packets + total_backward_packets AS DOUBLE) / flow_duration END
    AS flow_packets_per_s
FROM f
"""


@register("packets_to_flows", _FLOWS_SQL)
def packets_to_flows(spark, sf):
    return FL.packets_to_flows(packets(spark, sf), GAP_SECONDS)


def flow_model(spark, sf):
    """Flow classifier fitted on lineitem-as-flows (label l_returnflag)."""
    from flowlens.plans import standins as S
    from flowlens.streaming import score as SC
    from flowlens.plans.q_ml import _cached
    def fit():
        lf = SC.spread_rows(S.line_flows(spark, sf), S.LINE_KEY)
        return SC.with_label_text(SC.flow_pipeline(SC.SCORE_FEATURES, "l_returnflag").fit(lf))
    return _cached(spark, ("flow_model", sf), fit)


@register("streaming_score")
def streaming_score(spark, sf):
    """ST4 batch twin: the packet flows scored by the fitted flow pipeline (the same
    model scores the streaming flows in ``streaming.score.start_flow_scoring``)."""
    from flowlens.streaming import score as SC
    flows = FL.packets_to_flows(packets(spark, sf), GAP_SECONDS)
    return SC.score_flows(flow_model(spark, sf), flows, keep=[*FL.KEY, "session_start"])
