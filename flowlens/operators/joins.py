"""Join helpers: broadcast only behind a checked size bound."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows a small side may have and still be broadcast. Small sides here are class tables,
# (class x hash-bucket) counts, model lists and profile ranges. Beyond the bound the join
# falls back to a regular (shuffle) join chosen by Catalyst / AQE.
BROADCAST_MAX_ROWS = 200_000


def bounded_count(df: DataFrame, bound: int) -> int:
    """Exact row count when it is <= ``bound``, else ``bound + 1`` (stops early)."""
    return df.limit(bound + 1).count()


def join_groups(big: DataFrame, small: DataFrame, on: Sequence[str] | str, how: str = "inner",
                max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """``join_small`` on group columns where NULL is a group of its own (as in GROUP BY)."""
    keys = [on] if isinstance(on, str) else list(on)
    named = small.withColumnsRenamed({k: f"__group_{k}" for k in keys})
    same = reduce(lambda a, b: a & b, (F.col(k).eqNullSafe(F.col(f"__group_{k}")) for k in keys))
    return join_small(big, named, same, how, max_rows).drop(*(f"__group_{k}" for k in keys))


def join_small(big: DataFrame, small: DataFrame, on, how: str = "inner",
               max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Join ``big`` with ``small``, broadcasting ``small`` only when it has at most
    ``max_rows`` rows.

    The small side is computed ONCE: at most ``max_rows + 1`` rows are fetched; when
    within the bound, that materialised copy is broadcast (so the join does not recompute
    it, and its lineage is cut); otherwise the original frame joins by shuffle."""
    local = fetch_bounded(small, max_rows)
    if local is not None:
        return big.join(F.broadcast(local), on=on, how=how)
    return big.join(small, on=on, how=how)


def fetch_bounded(df: DataFrame, max_rows: int) -> DataFrame | None:
    """At most ``max_rows`` rows of ``df`` as a local (driver-built) DataFrame, moved
    through Arrow; None when ``df`` has more rows."""
    table = df.limit(max_rows + 1).toArrow()
    if table.num_rows > max_rows:
        return None
    return df.sparkSession.createDataFrame(table, schema=df.schema)


def materialize_small(df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS) -> DataFrame:
    """Compute a bounded small table once and return it as local data (raises when it
    exceeds ``max_rows``)."""
    local = fetch_bounded(df, max_rows)
    if local is None:
        raise ValueError(f"expected at most {max_rows} rows")
    return local


def lookup_with_default(df: DataFrame, key: str, dim: DataFrame, dim_key: str,
                        value: str, out: str, default: str) -> DataFrame:
    """Code -> name, left outer, missing -> ``default``."""
    d = dim.select(F.col(dim_key).alias("__k"), F.col(value).alias("__v"))
    j = join_small(df, d, on=F.col(key) == F.col("__k"), how="left")
    return j.withColumn(out, F.coalesce(F.col("__v"), F.lit(default))).drop("__k", "__v")


def anti_keys(df: DataFrame, dim: DataFrame, on: Sequence[str] | str) -> DataFrame:
    """Rows of ``df`` without a partner in ``dim`` (J2 unmatched check, J5 missing set)."""
    return join_small(df, dim.select(*([on] if isinstance(on, str) else on)).distinct(),
                      on=on, how="left_anti")
