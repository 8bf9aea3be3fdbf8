"""Projection and cleaning operators.

All are narrow (map-only) transformations: no shuffle, stay inside whole-stage codegen.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.functions import fixed
from flowlens.functions.scalar import value_text

INF = float("inf")


def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    """Names of numeric columns (plan-time, from the schema)."""
    return [f.name for f in df.schema.fields
            if isinstance(f.dataType, T.NumericType) and f.name not in exclude]


def non_finite(c: Column) -> Column:
    """True for NULL, NaN, +Inf and -Inf."""
    return c.isNull() | F.isnan(c) | c.isin(INF, -INF)


def clean_value(c: Column, value: float = 0.0) -> Column:
    """+-Inf -> NaN -> ``value`` (NULL too)."""
    return F.when(non_finite(c), F.lit(value)).otherwise(c)


def clean_fill(df: DataFrame, cols: Sequence[str] | None = None, value: float = 0.0) -> DataFrame:
    """Replace non-finite values of the numeric ``cols`` by ``value``."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    return df.withColumns({c: clean_value(F.col(c), value).cast(df.schema[c].dataType)
                           for c in cols})


def clean_drop(df: DataFrame, cols: Sequence[str] | None = None) -> DataFrame:
    """P5: drop rows with a non-finite value in any of ``cols`` (pushed into the scan
    as a filter; no shuffle)."""
    cols = list(cols) if cols is not None else numeric_columns(df)
    bad = None
    for c in cols:
        cond = non_finite(F.col(c))
        bad = cond if bad is None else (bad | cond)
    return df if bad is None else df.filter(~bad)


def replace_sentinel(df: DataFrame, cols: Sequence[str], sentinel: float = -1,
                     value: float = 0) -> DataFrame:
    """``sentinel`` -> ``value`` in the window-size columns that are present."""
    present = [c for c in cols if c in df.columns]
    return df.withColumns({c: F.when(F.col(c) == sentinel, F.lit(value).cast(df.schema[c].dataType))
                           .otherwise(F.col(c)) for c in present})


def nan_to_zero(c: Column) -> Column:
    """NaN/NULL probability -> 0."""
    return F.nanvl(F.coalesce(c, F.lit(0.0)), F.lit(0.0))


def rate(num: Column, duration: Column) -> Column:
    """Num / duration, 0 when duration is 0 (or NULL)."""
    return F.when(duration.isNull() | (duration == 0), F.lit(0.0)).otherwise(
        F.try_divide(num.cast("double"), duration.cast("double")))


def flow_rates(df: DataFrame, duration: str, fwd_bytes: str, bwd_bytes: str, fwd_pkts: str,
               bwd_pkts: str, bytes_out: str = "flow_bytes_per_s",
               pkts_out: str = "flow_packets_per_s") -> DataFrame:
    """bytes/s and packets/s of a flow; 0 when the duration is 0."""
    d = F.col(duration)
    return df.withColumns({
        bytes_out: rate(F.col(fwd_bytes) + F.col(bwd_bytes), d),
        pkts_out: rate(F.col(fwd_pkts) + F.col(bwd_pkts), d),
    })


def clamp_non_negative(df: DataFrame, count_cols: Sequence[str] = (),
                       real_cols: Sequence[str] = ()) -> DataFrame:
    """P10: counts -> max(0, int(x)) (truncation toward 0); reals -> max(0, x)."""
    out = {c: F.greatest(F.lit(0), F.col(c).cast("long")) for c in count_cols}
    out.update({c: F.greatest(F.lit(0.0), F.col(c).cast("double")) for c in real_cols})
    return df.withColumns(out)


def default_for_name(name: str, table: Mapping[str, float] | None = None) -> float:
    """Default value of a feature from its name; first matching rule wins."""
    if table and name in table:
        return float(table[name])
    for words, value in fixed.DEFAULT_RULES:
        if any(w in name for w in words):
            return float(value)
    return float(fixed.DEFAULT_FALLBACK)


def benign_defaults() -> dict[str, float]:
    """P11 table: midpoints of the Benign profile ranges plus the two derived rates."""
    mids = {feat: (lo + hi) / 2 for feat, lo, hi in fixed.CLASS_PROFILE[0][1]}
    dur = mids["Flow Duration"]
    mids["Flow Bytes/s"] = (mids["Total Length of Fwd Packets"]
                            + mids["Total Length of Bwd Packets"]) / dur
    mids["Flow Packets/s"] = (mids["Total Fwd Packets"] + mids["Total Backward Packets"]) / dur
    return mids


def fill_by_name_rule(df: DataFrame, names: Mapping[str, str],
                      table: Mapping[str, float] | None = None) -> DataFrame:
    """Fill NULLs of each column from the rule on its feature name.

    ``names`` maps column -> feature name (the rule reads the original spelling).
    The defaults are resolved at plan time into one ``na.fill`` map.
    """
    return df.na.fill({c: default_for_name(n, table) for c, n in names.items()})


def drop_if_present(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Drop columns, ignoring missing ones."""
    return df.drop(*cols)


def unpivot_long(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 name_col: str = "feature", value_col: str = "value") -> DataFrame:
    """Row -> (feature, value) rows; one ``Expand`` pass, no shuffle."""
    return df.select(*ids, *[F.col(c).cast("double").alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name_col, value_col)


def unpivot_text(df: DataFrame, ids: Sequence[str], cols: Sequence[str],
                 name_col: str = "feature", value_col: str = "value_text") -> DataFrame:
    """P18 + F6: row -> (feature, text) rows, each value formatted by its own column's type."""
    types = dict(df.dtypes)
    return df.select(*ids, *[value_text(F.col(c), types[c]).alias(c) for c in cols]).unpivot(
        list(ids), list(cols), name_col, value_col)


def pad_results(frames: Sequence[DataFrame], feature_cols: Sequence[str],
                model_cols: Sequence[str], fill: str | None = "N/A") -> DataFrame:
    """Union result records with different columns; order features, then sorted
    model columns, then sorted others; values as text, missing -> ``fill``
    (``fill=None``: the second form, which keeps missing values NULL and types as is)."""
    merged = frames[0]
    for f in frames[1:]:
        merged = merged.unionByName(f, allowMissingColumns=True)
    present = set(merged.columns)
    feats = [c for c in feature_cols if c in present]
    models = sorted({c for c in model_cols if c in present})
    others = sorted(present - set(feats) - set(models))
    order = feats + models + others
    if fill is None:
        return merged.select(*order)
    return merged.select(*[F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias(c)
                           for c in order])
