"""Order-dependent operators that stay distributed.

A window with no PARTITION BY (or with a few huge partitions, e.g. one per class) runs in
a single task. These helpers split the ordered key space into range buckets, run the
window inside each (group, bucket), and stitch bucket boundaries through a small
per-bucket summary table (groups x buckets rows, broadcast behind a size check).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from flowlens.operators.joins import join_groups


def default_buckets(df: DataFrame) -> int:
    """Buckets per group: a few per shuffle partition, so each window task stays small."""
    return max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "8"))) * 4


def add_range_bucket(df: DataFrame, order: str, groups: Sequence[str], n_buckets: int,
                     desc: bool = False, bucket: str = "__bucket",
                     width: float | None = None, ranges: DataFrame | None = None,
                     bounds: DataFrame | None = None) -> DataFrame:
    """Equal-width range bucket of ``order`` within each group (0 = first in order).

    With ``width`` the buckets are fixed slices of the order axis shared by all groups
    (use when there are many groups: a group only gets the buckets it has rows in).
    With ``bounds`` (groups + ``__bounds``: sorted inner boundaries, e.g. approximate
    quantiles) the buckets are equal-depth: bucket = boundaries below the value, so a
    crowded value range still spreads over many buckets."""
    if bounds is not None:
        j = join_groups(df, bounds.select(*groups, "__bounds"), on=groups) if groups \
            else df.withColumn("__bounds", F.lit(bounds.first()["__bounds"]))
        below = F.size(F.filter("__bounds", lambda b: b < F.col(order)))
        nb = F.size("__bounds")
        return j.withColumn(bucket, (nb - below) if desc else below).drop("__bounds")
    if width:
        x = F.floor(F.col(order).cast("double") / float(width))
        return df.withColumn(bucket, (-x if desc else x).cast("long"))
    if groups:
        if ranges is None:
            ranges = df.groupBy(*groups).agg(F.min(order).alias("__lo"), F.max(order).alias("__hi"))
            j = join_groups(df, ranges, on=groups)
        else:  # already materialised by the caller (groups x 2 values)
            j = join_groups(df, ranges.select(*groups, "__lo", "__hi"), on=groups)
    else:
        j = _attach_global(df, df.agg(F.min(order).alias("__lo"), F.max(order).alias("__hi")))
    lo, hi, x = F.col("__lo").cast("double"), F.col("__hi").cast("double"), F.col(order).cast("double")
    pos = F.when(hi > lo, (x - lo) / (hi - lo)).otherwise(F.lit(0.0))
    if desc:
        pos = F.lit(1.0) - pos
    b = F.least(F.lit(n_buckets - 1), F.floor(pos * n_buckets).cast("int"))
    return j.withColumn(bucket, b).drop("__lo", "__hi")


def _attach_global(df: DataFrame, ranges: DataFrame) -> DataFrame:
    """Attach the one-row global (lo, hi) as literals (bounded: a single row)."""
    r = ranges.first()
    return df.withColumns({"__lo": F.lit(r["__lo"]), "__hi": F.lit(r["__hi"])})


def global_lag(df: DataFrame, order: str, cols: Sequence[str], n_buckets: int | None = None,
               suffix: str = "_prev", groups: Sequence[str] = (),
               width: float | None = None) -> DataFrame:
    """``lag(c)`` within ``groups`` (default: the whole table) ordered by ``order``
    (unique within a group, non-null), computed in parallel: lag inside range buckets,
    and each bucket's first row takes the last row of the group's previous non-empty
    bucket (from a groups x buckets summary)."""
    n_buckets = n_buckets or default_buckets(df)
    g = list(groups)
    b = add_range_bucket(df, order, g, n_buckets, width=width)
    w = Window.partitionBy(*g, "__bucket").orderBy(order)
    inner = b.withColumns({"__first": F.lag(order).over(w).isNull(),
                           **{f"__lag_{c}": F.lag(c).over(w) for c in cols}})
    last = b.groupBy(*g, "__bucket").agg(
        F.max_by(F.struct(*cols), F.col(order)).alias("__last"))
    # one row per non-empty (group, bucket): small, so the ordered window is cheap
    last = last.withColumn("__prev_last", F.lag("__last").over(
        Window.partitionBy(*g).orderBy("__bucket"))).select(*g, "__bucket", "__prev_last")
    j = join_groups(inner, last, on=[*g, "__bucket"])
    return j.withColumns({
        f"{c}{suffix}": F.when(F.col("__first"), F.col(f"__prev_last.{c}"))
        .otherwise(F.col(f"__lag_{c}")) for c in cols
    }).drop("__bucket", "__first", "__prev_last", *[f"__lag_{c}" for c in cols])


def running_sum(df: DataFrame, groups: Sequence[str], order: str, cols: Sequence[str],
                desc: bool = True, n_buckets: int | None = None,
                suffix: str = "_cum", width: float | None = None,
                ranges: DataFrame | None = None, bounds: DataFrame | None = None) -> DataFrame:
    """Cumulative sums of ``cols`` within ``groups`` ordered by the unique-per-group
    ``order`` column (rows up to and including the current one).

    Distributed: running sum inside (group, range bucket), plus the total of all earlier
    buckets of the group from a (groups x buckets)-row summary."""
    n_buckets = n_buckets or default_buckets(df)
    b = add_range_bucket(df, order, groups, n_buckets, desc=desc, width=width, ranges=ranges,
                         bounds=bounds)
    o = F.col(order).desc() if desc else F.col(order).asc()
    w = Window.partitionBy(*groups, "__bucket").orderBy(o).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    inner = b.withColumns({f"__in_{c}": F.sum(c).over(w) for c in cols})
    tot = b.groupBy(*groups, "__bucket").agg(*[F.sum(c).alias(f"__t_{c}") for c in cols])
    wb = Window.partitionBy(*groups).orderBy("__bucket").rowsBetween(
        Window.unboundedPreceding, -1)
    off = tot.select(*groups, "__bucket", *[F.coalesce(F.sum(f"__t_{c}").over(wb), F.lit(0))
                                             .alias(f"__off_{c}") for c in cols])
    j = join_groups(inner, off, on=[*groups, "__bucket"])
    return j.withColumns({f"{c}{suffix}": F.col(f"__off_{c}") + F.col(f"__in_{c}")
                          for c in cols}).drop(
        "__bucket", *[f"__in_{c}" for c in cols], *[f"__off_{c}" for c in cols])


RANK_HASH_DIGITS_CONF = "flowlens.rank.hashDigits"


def hash_rank(df: DataFrame, groups: Sequence[str], key: str, rank: str = "rank",
              hash_col: str = "__h", bucket_bits: int | None = None,
              total: str | None = None) -> DataFrame:
    """Exact rank 1.. within ``groups`` by (md5(key as text), key), distributed.

    The first hex digits of the md5 pick one of 16**digits buckets (session setting
    ``flowlens.rank.hashDigits``, default 3 = 4096; raise it as data grows so one
    (group, bucket) stays a task-sized sort); since md5 is uniform, a class holding a
    third of all rows is still spread over all buckets.
    rank = rows of the group in earlier buckets + row_number inside (group, bucket).
    ``total`` (optional) names a column with the group's row count, taken from the same
    (group x bucket) count table (no extra pass)."""
    if bucket_bits is None:  # session setting (hex digits of md5 -> 16**digits buckets)
        nb_hex = int(df.sparkSession.conf.get(RANK_HASH_DIGITS_CONF, "3"))
    else:
        nb_hex = max(1, (bucket_bits + 3) // 4)
    h = F.md5(F.col(key).cast("string"))
    d = df.withColumns({hash_col: h,
                        "__hb": F.conv(F.substring(h, 1, nb_hex), 16, 10).cast("int")})
    w = Window.partitionBy(*groups, "__hb").orderBy(F.col(hash_col), F.col(key))
    inner = d.withColumn("__rn", F.row_number().over(w))
    counts = d.groupBy(*groups, "__hb").agg(F.count(F.lit(1)).alias("__n"))
    wb = Window.partitionBy(*groups).orderBy("__hb").rowsBetween(Window.unboundedPreceding, -1)
    extra = [F.sum("__n").over(Window.partitionBy(*groups)).alias(total)] if total else []
    off = counts.select(*groups, "__hb", F.coalesce(F.sum("__n").over(wb), F.lit(0)).alias("__off"),
                        *extra)
    j = join_groups(inner, off, on=[*groups, "__hb"])
    return j.withColumn(rank, (F.col("__off") + F.col("__rn")).cast("long")).drop(
        "__hb", "__rn", "__off")
