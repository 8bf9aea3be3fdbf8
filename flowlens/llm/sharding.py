"""Operator 6, sharding by extendible hashing (DataFrame functions only).

A row's place is the md5 of its key as ``HASH_BITS`` bits. The directory starts with one
bucket; a bucket whose rows exceed the byte limit splits on its next bit, others stay, until
every bucket fits. A bucket is therefore the shortest prefix of the hash whose rows fit while
those of every shorter prefix do not. Sizes of all prefixes come from one pre-aggregated
count per ``width`` bits, rolled up; only buckets that still exceed the limit at that width
are counted on, ``MORE_BITS`` bits at a time.

The key holds the id and the md5 of the text, so equal ids do not share a place unless the
rows are equal. Rows that no bit can part (equal rows, or one row above the limit) stay in
one bucket, dealt over numbered pages: rows of one size fill page after page by their running
number, as many as fit. A page exceeds the limit only if it is a single row that does.

Defined results: null text counts no bytes; null ids have a place like any other; an empty
table gives no rows; only the id and the text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from flowlens.llm import common as C

LIMIT_BYTES = 4 << 20
HASH_BITS, MORE_BITS = 60, 8


def place_bits(id_col: Column, text: Column) -> Column:
    """``HASH_BITS`` bits as text, from the first hex digits of the md5."""
    key = F.md5(F.concat_ws(":", F.coalesce(id_col.cast("string"), F.lit("")),
                            F.coalesce(F.md5(text), F.lit(""))))
    return F.lpad(F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 2), HASH_BITS, "0")


def prefix_sizes(sizes: DataFrame, low: int, high: int) -> DataFrame:
    """Roll ``sizes(bits, bytes, n)`` up to every prefix of ``low`` to ``high`` bits."""
    depths = F.explode(F.sequence(F.lit(low), F.lit(high))).alias("depth")
    return (sizes.select("bits", "bytes", "n", depths)
            .groupBy(F.expr("left(bits, depth)").alias("shard"), "depth")
            .agg(F.sum("bytes").alias("shard_bytes"), F.sum("n").alias("shard_rows")))


def directory(rows: DataFrame, limit: int) -> DataFrame:
    """(shard, depth, shard_bytes, shard_rows): the buckets of ``rows(bits, bytes)``."""
    total = rows.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    width = min(HASH_BITS, max(0, math.ceil(math.log2(max(1, total / limit)))) + 4)
    low, done, open_rows = 0, None, rows
    while True:
        sizes = open_rows.groupBy(F.expr(f"left(bits, {width})").alias("bits")).agg(
            F.sum("bytes").alias("bytes"), F.count("*").alias("n"))
        found = C.staged(prefix_sizes(sizes, low, width), "prefixes")
        parents = found.where(F.col("shard_bytes") > limit).select(
            F.col("shard").alias("above"), (F.col("depth") + 1).alias("depth"))
        reached = (found.join(parents, (F.expr("left(shard, greatest(length(shard) - 1, 0))") == F.col("above"))
                              & (found.depth == parents.depth), "left_semi")
                   .unionByName(found.where(F.col("depth") == low)))
        fits = (F.col("shard_bytes") <= limit) | (F.col("depth") == HASH_BITS)
        done = reached.where(fits) if done is None else done.unionByName(reached.where(fits))
        left = reached.where(~fits & (F.col("depth") == width)).select(F.col("shard").alias("above"))
        if width == HASH_BITS or left.isEmpty():
            return done
        open_rows = C.staged(open_rows.join(left, F.expr(f"left(bits, {width})") == F.col("above"), "left_semi"), "open")
        low, width = width + 1, min(HASH_BITS, width + MORE_BITS)
        # every bucket that is still open exceeds the limit, so its two halves are wanted


def paged(over: DataFrame, limit: int) -> DataFrame:
    """Adds ``page`` to the rows ``(shard, shard_rows, bytes, row, ...)`` of buckets above the limit.

    Rows are numbered in about sqrt(rows) parts of their bucket behind the counts of the parts
    before, so no task holds a bucket. Sizes of one bucket (one, but for hash collisions) have
    pages of their own.
    """
    over = over.withColumn("part", F.pmod(F.xxhash64("row"), F.ceil(F.sqrt("shard_rows"))))
    fit = F.greatest(F.lit(1), F.floor(F.lit(limit) / F.greatest(F.col("bytes"), F.lit(1)))).cast("long")
    size, part = ["shard", "bytes"], ["shard", "bytes", "part"]
    counts = over.groupBy(*part).agg(F.count("*").alias("n"))
    pages = counts.groupBy(*size).agg(F.sum("n").alias("n")).select(*size, F.ceil(F.col("n") / fit).alias("pages"))

    def before(col: str, keys: list[str], order: str) -> Column:
        w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(col).over(w), F.lit(0))

    starts = (counts.select(*part, before("n", size, "part").alias("rank_from"))
              .join(pages.select(*size, before("pages", ["shard"], "bytes").alias("page_from")), size))
    rank = F.col("rank_from") + F.row_number().over(Window.partitionBy(*part).orderBy("row")) - 1
    return (over.join(starts, part)
            .withColumn("page", (F.col("page_from") + F.floor(rank / fit)).cast("int"))
            .drop("part", "rank_from", "page_from"))


def shards(df: DataFrame, limit: int = LIMIT_BYTES, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, shard, depth, page, shard_bytes, shard_rows) of every row."""
    text = F.col(f"`{text_col}`").cast("string")
    rows = C.staged(df.select(F.col(f"`{id_col}`").alias("id"), F.monotonically_increasing_id().alias("row"), place_bits(F.col(f"`{id_col}`"), text).alias("bits"),
                              F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes")), "places")
    buckets = C.staged(directory(rows.select("bits", "bytes"), limit), "directory")
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())    # HASH_BITS at most
    prefixes = F.array(*(F.expr(f"left(bits, {d})") for d in depths)) if depths else F.array(F.lit(""))
    placed = (rows.select("id", "row", "bytes", "bits", F.explode(prefixes).alias("shard"))
              .join(buckets, "shard"))
    above = F.col("shard_bytes") > limit
    out = placed.withColumn("page", F.lit(0))
    if not buckets.where(above).isEmpty():
        out = out.where(~above).unionByName(paged(placed.where(above), limit))
    return out.select("id", F.col("bytes").alias("n_bytes"), "shard", F.col("depth").cast("int").alias("depth"),
                      "page", "shard_bytes", "shard_rows")


def write_shards(df: DataFrame, path: str, limit: int = LIMIT_BYTES, id_col: str = "doc_id",
                 text_col: str = "text") -> None:
    """Write the table's rows under ``path``, one folder per shard (and page).

    Rows meet their shard by place bits, and one task writes one shard and page.
    """
    text = F.col(f"`{text_col}`").cast("string")
    buckets = shards(df, limit, id_col, text_col).select("shard", "depth", "shard_bytes", "shard_rows").distinct()
    depths = sorted(r[0] for r in buckets.select("depth").distinct().collect())
    bits = place_bits(F.col(f"`{id_col}`"), text)
    prefixes = F.array(*(F.substring(bits, 1, d) for d in depths)) if depths else F.array(F.lit(""))
    kept = [F.col(f"`{c}`") for c in df.columns]
    placed = (df.select(F.struct(*kept).alias("whole"), F.monotonically_increasing_id().alias("row"),
                        F.coalesce(F.octet_length(text), F.lit(0)).cast("long").alias("bytes"), F.explode(prefixes).alias("shard"))
              .join(buckets.drop("depth"), "shard"))
    above = F.col("shard_bytes") > limit
    out = placed.withColumn("page", F.lit(0))
    if not buckets.where(above).isEmpty():
        out = out.where(~above).unionByName(paged(C.staged(placed.where(above), "paged"), limit))
    (out.repartition("shard", "page")
     .select(F.col("whole").alias("row"), F.concat(F.lit("b"), "shard").alias("shard"), "page")
     .write.partitionBy("shard", "page").parquet(path))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: shard and page of every document."""
    return shards(C.table(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


# Rows of a bucket above the limit are equal, so any numbering of them gives the same rows.
ORACLE_SQL = f"""
WITH p AS (SELECT doc_id, coalesce(octet_length(encode(text)), 0)::BIGINT AS n_bytes,
                  md5(coalesce(doc_id::VARCHAR, '') || ':' || coalesce(md5(text), '')) AS h FROM documents),
b AS (SELECT doc_id, n_bytes, right(
        bin(('0x' || substr(h, 1, 8))::UBIGINT + (1::UBIGINT << 32)), 32) ||
        right(bin(('0x' || substr(h, 9, 7))::UBIGINT + (1::UBIGINT << 28)), 28) AS bits FROM p),
s AS (SELECT left(bits, d) AS shard, d, sum(n_bytes)::BIGINT AS shard_bytes, count(*) AS shard_rows
      FROM b, range({HASH_BITS} + 1) r(d) GROUP BY ALL),
kept AS MATERIALIZED (
  SELECT s.shard, s.d, s.shard_bytes, s.shard_rows
  FROM s LEFT JOIN s a ON a.d = s.d - 1 AND a.shard = left(s.shard, s.d - 1)
  WHERE (s.shard_bytes <= {LIMIT_BYTES} OR s.d = {HASH_BITS}) AND (s.d = 0 OR a.shard_bytes > {LIMIT_BYTES}))
SELECT b.doc_id, b.n_bytes, kept.shard, kept.d::INTEGER AS depth,
       CASE WHEN kept.shard_bytes <= {LIMIT_BYTES} THEN 0 ELSE (row_number() OVER (PARTITION BY kept.shard) - 1)
            // greatest(1, {LIMIT_BYTES} // greatest(b.n_bytes, 1)) END::INTEGER AS page,
       kept.shard_bytes, kept.shard_rows
FROM b JOIN kept ON starts_with(b.bits, kept.shard)
"""
