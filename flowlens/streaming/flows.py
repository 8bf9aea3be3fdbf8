"""Packets -> flows, batch and Structured Streaming (ST1-ST5, K5).

A flow is the packets of one bidirectional key (least(src, dst), greatest(src, dst),
protocol) with no silence longer than ``gap``. The forward side is the source of the
earliest packet. All flow features come from ONE aggregation per flow: the side of each
packet is decided relative to the key's two endpoints, and the forward side is picked
afterwards, so stream and batch share the same aggregate list.

Batch sessionization is distributed: one window pass over (key, time bucket) plus a
small per-bucket boundary table (a key holding a third of all packets is split over its
time buckets). Streaming uses ``session_window`` + watermark.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowlens.functions.scalar import ieee_divide  # noqa: F401  (re-export for users)
from flowlens.operators.clean import rate
from flowlens.operators.joins import join_small

KEY = ["src_a", "dst_b", "protocol"]

FLOW_FEATURES = ["flow_duration", "total_fwd_packets", "total_backward_packets",
                 "total_length_of_fwd_packets", "total_length_of_bwd_packets",
                 "fwd_packet_length_mean", "bwd_packet_length_mean", "flow_bytes_per_s",
                 "flow_packets_per_s", "init_win_bytes_forward", "init_win_bytes_backward"]


def packet_records(df: DataFrame, keep: list[str] | tuple = ()) -> DataFrame:
    """ST1: packet rows with fallbacks (source/destination '' and protocol/length 0 when
    absent); a record without a timestamp is skipped. Adds the flow key; ``keep`` columns
    are carried through."""
    src = F.coalesce(F.col("source"), F.lit(""))
    dst = F.coalesce(F.col("destination"), F.lit(""))
    out = df.where(F.col("ts_us").isNotNull()).select(
        "packet_id", "ts_us", src.alias("source"), dst.alias("destination"),
        F.coalesce(F.col("protocol"), F.lit(0)).alias("protocol"),
        F.coalesce(F.col("length"), F.lit(0)).cast("long").alias("length"),
        F.col("window_size").cast("long").alias("window_size"), *keep)
    return out.withColumns({"src_a": F.least("source", "destination"),
                            "dst_b": F.greatest("source", "destination")})


EPOCH_NTZ = "1970-01-01 00:00:00"


def epoch_micros(df: DataFrame, col: str) -> Column:
    """Microseconds since the epoch, independent of the session time zone: a wall-clock
    (timestamp_ntz) value counts from the wall-clock epoch; an instant (timestamp) uses
    its own epoch micros."""
    if df.schema[col].dataType.typeName() == "timestamp_ntz":
        return F.timestamp_diff("MICROSECOND", F.lit(EPOCH_NTZ).cast("timestamp_ntz"), F.col(col))
    return F.unix_micros(F.col(col).cast("timestamp"))


def micros_to_ntz(c: Column) -> Column:
    """Inverse of ``epoch_micros`` for wall-clock output (time-zone independent)."""
    return F.timestamp_add("MICROSECOND", c, F.lit(EPOCH_NTZ).cast("timestamp_ntz"))


def events_as_packets(events: DataFrame) -> DataFrame:
    """Stand-in packet feed from ``events``: user <-> 'server'; view/click/signup travel
    user -> server, purchase/error server -> user; protocol 6; length = value in
    hundredths; window size = (event_id mod 64) * 1024."""
    user = F.concat(F.lit("user-"), F.col("user_id").cast("string"))
    up = F.col("event_type").isin("view", "click", "signup")
    return events.select(
        F.col("event_id").alias("packet_id"),
        epoch_micros(events, "ts").alias("ts_us"),
        F.when(up, user).otherwise(F.lit("server")).alias("source"),
        F.when(up, F.lit("server")).otherwise(user).alias("destination"),
        F.lit(6).alias("protocol"),
        F.round(F.col("value") * 100).cast("long").alias("length"),
        ((F.col("event_id") % 64) * 1024).alias("window_size"))


def _flow_aggs() -> list[Column]:
    first = F.struct("ts_us", "packet_id")
    side_a = F.col("source") == F.col("src_a")
    side_b = (F.col("source") == F.col("dst_b")) & (F.col("src_a") != F.col("dst_b"))
    return [
        F.min("ts_us").alias("__t0"), F.max("ts_us").alias("__t1"),
        F.min_by("source", first).alias("__fwd_src"),
        F.count_if(side_a).alias("__n_a"), F.count_if(side_b).alias("__n_b"),
        F.sum(F.when(side_a, F.col("length"))).alias("__bytes_a"),
        F.sum(F.when(side_b, F.col("length"))).alias("__bytes_b"),
        F.avg(F.when(side_a, F.col("length"))).alias("__mean_a"),
        F.avg(F.when(side_b, F.col("length"))).alias("__mean_b"),
        F.min_by(F.when(side_a, F.col("window_size")), F.when(side_a, first)).alias("__win_a"),
        F.min_by(F.when(side_b, F.col("window_size")), F.when(side_b, first)).alias("__win_b"),
    ]


def _flow_features(df: DataFrame, keep: list) -> DataFrame:
    fwd_a = F.col("__fwd_src") == F.col("src_a")

    def pick(a, b):
        return F.when(fwd_a, F.col(a)).otherwise(F.col(b))

    def other(a, b):
        return F.when(fwd_a, F.col(b)).otherwise(F.col(a))

    dur = (F.col("__t1") - F.col("__t0")) / 1e6
    out = df.select(
        *keep,
        dur.alias("flow_duration"),
        pick("__n_a", "__n_b").alias("total_fwd_packets"),
        other("__n_a", "__n_b").alias("total_backward_packets"),
        F.coalesce(pick("__bytes_a", "__bytes_b"), F.lit(0)).cast("long").alias("total_length_of_fwd_packets"),
        F.coalesce(other("__bytes_a", "__bytes_b"), F.lit(0)).cast("long").alias("total_length_of_bwd_packets"),
        F.coalesce(pick("__mean_a", "__mean_b"), F.lit(0.0)).alias("fwd_packet_length_mean"),
        F.coalesce(other("__mean_a", "__mean_b"), F.lit(0.0)).alias("bwd_packet_length_mean"),
        F.coalesce(pick("__win_a", "__win_b"), F.lit(0)).cast("long").alias("init_win_bytes_forward"),
        F.coalesce(other("__win_a", "__win_b"), F.lit(0)).cast("long").alias("init_win_bytes_backward"),
    )
    total_bytes = F.col("total_length_of_fwd_packets") + F.col("total_length_of_bwd_packets")
    total_pkts = F.col("total_fwd_packets") + F.col("total_backward_packets")
    return out.withColumns({"flow_bytes_per_s": rate(total_bytes, F.col("flow_duration")),
                            "flow_packets_per_s": rate(total_pkts, F.col("flow_duration"))})


def sessionize(packets: DataFrame, gap_seconds: float, bucket_seconds: float = 86400.0) -> DataFrame:
    """Batch: session number per packet (1.. within its key); a new session starts when
    the silence since the key's previous packet exceeds ``gap_seconds``.

    One window pass partitioned by (key, time bucket): lag and a running count of
    starts inside the bucket. A small (key, bucket) summary (first / last time, starts)
    then gives each bucket whether its first packet opens a session and how many sessions
    began in earlier buckets. A key holding a third of all packets is split over its time
    buckets; ``bucket_seconds`` sets how much one task sorts."""
    gap_us = int(gap_seconds * 1e6)
    width = float(bucket_seconds * 1e6)
    p = packets.withColumn("__bucket", F.floor(F.col("ts_us") / width).cast("long"))
    w = Window.partitionBy(*KEY, "__bucket").orderBy("ts_us", "packet_id")
    prev = F.lag("ts_us").over(w)
    p = p.withColumn("__ls", (prev.isNotNull() & (F.col("ts_us") - prev > gap_us)).cast("int"))
    p = p.withColumn("__lcum", F.sum("__ls").over(
        w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    summary = p.groupBy(*KEY, "__bucket").agg(
        F.min("ts_us").alias("__first"), F.max("ts_us").alias("__last"),
        F.sum("__ls").alias("__n_ls"))
    wb = Window.partitionBy(*KEY).orderBy("__bucket")
    prev_last = F.lag("__last").over(wb)
    summary = summary.withColumn("__fs", (prev_last.isNull() | (F.col("__first") - prev_last > gap_us))
                                 .cast("long"))
    summary = summary.withColumn("__off", F.coalesce(F.sum(F.col("__fs") + F.col("__n_ls")).over(
        wb.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = join_small(p, summary.select(*KEY, "__bucket", "__off", "__fs"), on=[*KEY, "__bucket"])
    return j.withColumn("session_no", (F.col("__off") + F.col("__fs") + F.col("__lcum")).cast("long")) \
        .drop("__bucket", "__ls", "__lcum", "__off", "__fs")


def packets_to_flows(packets: DataFrame, gap_seconds: float = 6 * 3600.0,
                     bucket_seconds: float = 86400.0) -> DataFrame:
    """ST2 (batch): one row per flow with the 11 flow features. ``bucket_seconds`` is the
    time slice one window task sorts per key (lower it when one key carries a large
    share of the traffic)."""
    s = sessionize(packets, gap_seconds, bucket_seconds)
    g = s.groupBy(*KEY, "session_no").agg(*_flow_aggs())
    g = g.withColumn("session_start", micros_to_ntz(F.col("__t0")))
    return _flow_features(g, [*KEY, "session_start"])


def stream_flows(packets: DataFrame, gap: str = "6 hours", watermark: str = "1 day") -> DataFrame:
    """ST2 (streaming): same features with ``session_window`` over event time; a flow is
    emitted (append mode) once the watermark passes its end; late packets past the
    watermark are dropped."""
    p = packets.withColumn("__event_time", F.timestamp_micros("ts_us"))
    g = (p.withWatermark("__event_time", watermark)
         .groupBy(*KEY, F.session_window("__event_time", gap).alias("__session"))
         .agg(*_flow_aggs()))
    g = g.withColumn("session_start", micros_to_ntz(F.col("__t0")))
    return _flow_features(g, [*KEY, "session_start"])


def latest_n(packets: DataFrame, n: int = 50) -> DataFrame:
    """K5: the newest ``n`` packets (distributed top-n)."""
    return packets.orderBy(F.col("ts_us").desc(), F.col("packet_id").desc()).limit(n)


def latest_n_sink(state_dir: str, n: int = 50):
    """ST3: ``foreachBatch`` function keeping the newest ``n`` packets in a parquet table
    under ``state_dir`` (a shared folder: survives driver and executor restarts).
    Each epoch merges the previous table with the batch's own top ``n`` and writes a
    new version; replays of an epoch overwrite the same version (idempotent). Versions
    older than the one it read are removed, so two are kept."""
    def _fn(batch: DataFrame, epoch_id: int) -> None:
        spark = batch.sparkSession
        top = latest_n(batch, n)
        prev_path = _latest_version(spark, state_dir, before=epoch_id)
        if prev_path is not None:
            top = top.unionByName(spark.read.parquet(prev_path))
        latest_n(top, n).write.mode("overwrite").parquet(f"{state_dir}/epoch={epoch_id:012d}")
        if prev_path is not None:
            _remove_before(spark, state_dir, os.path.basename(prev_path))
    return _fn


def _remove_before(spark, state_dir: str, version: str) -> None:
    """Delete the state versions that sort before ``version``."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("epoch=") and name < version:
            fs.delete(st.getPath(), True)


def _latest_version(spark, state_dir: str, before: int) -> str | None:
    """Path of the newest state version written by an epoch before ``before``."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(state_dir)
    fs = path.getFileSystem(conf)
    if not fs.exists(path):
        return None
    best = None
    for st in fs.listStatus(path):
        name = st.getPath().getName()
        if name.startswith("epoch="):
            e = int(name.split("=", 1)[1])
            if e < before and fs.exists(jvm.org.apache.hadoop.fs.Path(st.getPath(), "_SUCCESS")):
                best = max(best or -1, e)
    return None if best is None else os.path.join(state_dir, f"epoch={best:012d}")


def read_latest(spark, state_dir: str) -> DataFrame | None:
    p = _latest_version(spark, state_dir, before=2 ** 62)
    return None if p is None else spark.read.parquet(p)


def packet_stream(spark, sf_dir: str, max_files_per_trigger: int = 1) -> DataFrame:
    """The events parquet file as a stream source (the capture tool is not built)."""
    schema = spark.read.parquet(f"{sf_dir}/events.parquet").schema
    ev = (spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
          .option("maxFilesPerTrigger", max_files_per_trigger).parquet(sf_dir))
    return packet_records(events_as_packets(ev))


def packet_json_schema():
    """Packet record: timestamp (epoch seconds), source, destination, protocol, length and
    a nested ``features`` object with the 11 live-stream feature names."""
    from pyspark.sql import types as T

    from flowlens.functions.fixed import STREAM_FEATURES
    return T.StructType([
        T.StructField("timestamp", T.DoubleType()), T.StructField("source", T.StringType()),
        T.StructField("destination", T.StringType()), T.StructField("protocol", T.IntegerType()),
        T.StructField("length", T.LongType()), T.StructField("window_size", T.LongType()),
        T.StructField("features", T.StructType(
            [T.StructField(n, T.DoubleType()) for n in STREAM_FEATURES])),
    ])


def parse_packets(raw: DataFrame, value_col: str = "value", id_col: str | None = None) -> DataFrame:
    """ST1 for JSON packet records (file lines or Kafka values): parsed with a fixed
    schema; a record that does not parse or has no timestamp is skipped; absent fields
    fall back to '' / 0. Returns ``packet_records`` rows plus the nested ``features``."""
    parsed = raw.select(F.from_json(F.col(value_col).cast("string"), packet_json_schema(),
                                    {"mode": "PERMISSIVE"}).alias("p"),
                        *([F.col(id_col).alias("__id")] if id_col else []))
    ok = parsed.where(F.col("p").isNotNull() & F.col("p.timestamp").isNotNull())
    pid = F.col("__id") if id_col else F.xxhash64(F.to_json("p"))
    base = ok.select(pid.cast("long").alias("packet_id"),
                     (F.col("p.timestamp") * 1e6).cast("long").alias("ts_us"),
                     "p.source", "p.destination", "p.protocol", "p.length", "p.window_size",
                     "p.features")
    return packet_records(base, keep=["features"])


def kafka_packet_stream(spark, servers: str, topic: str, starting: str = "latest") -> DataFrame:
    """S10 on a message bus: packet JSON records from a Kafka topic (needs the Kafka
    connector on the cluster's classpath); offsets are tracked by the query checkpoint."""
    raw = (spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers)
           .option("subscribe", topic).option("startingOffsets", starting).load())
    # an offset is unique within its partition only
    numbered = raw.withColumn("packet", F.col("partition").cast("long") * F.lit(1 << 44) + F.col("offset"))
    return parse_packets(numbered, "value", id_col="packet")
