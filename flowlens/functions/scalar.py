"""Scalar column functions (F1-F18, P8-P9 helpers).

Each returns a ``Column`` built from ``pyspark.sql.functions`` only, so everything stays
JVM-side inside whole-stage codegen. No Python UDFs.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from flowlens.functions import fixed

INF = float("inf")
NAN = float("nan")


def ieee_divide(num: Column, den: Column) -> Column:
    """num / den with IEEE results on a zero denominator (x/0 = +-Inf, 0/0 = NaN), as the
    reference's numpy arithmetic produces; Spark's ANSI division would raise instead."""
    num = num.cast("double")
    den = den.cast("double")
    return (F.when(den != 0, num / den)
            .when(num.isNull() | den.isNull(), F.lit(None).cast("double"))
            .when((num == 0) | F.isnan(num), F.lit(NAN))
            .when(num > 0, F.lit(INF))
            .otherwise(F.lit(-INF)))


def prediction_text(is_attack: Column) -> Column:
    """1 -> 'Attack' else 'Benign'."""
    return F.when(is_attack, F.lit("Attack")).otherwise(F.lit("Benign"))


def attack_code(benign_prob: Column, attack_prob: Column,
                threshold: float = fixed.BENIGN_THRESHOLD) -> Column:
    """benign when p0 >= t, else by attack probability: < .6 probe, < .8 dos, else web."""
    return (F.when(benign_prob >= threshold, F.lit("benign"))
            .when(attack_prob < fixed.PROBE_BELOW, F.lit("probe"))
            .when(attack_prob < fixed.DOS_BELOW, F.lit("dos"))
            .otherwise(F.lit("web")))


def attack_name(code: Column, is_attack: Column) -> Column:
    """code -> display name, 'Unknown' when not in the table, 'N/A' when not an attack.

    The table has 4 fixed rows, so it is a map literal (no join)."""
    m = F.create_map(*[F.lit(x) for pair in fixed.ATTACK_TYPES for x in pair])
    return F.when(is_attack, F.coalesce(F.try_element_at(m, code), F.lit(fixed.UNKNOWN_ATTACK))
                  ).otherwise(F.lit(fixed.NOT_ATTACK))


def confidence(is_attack: Column, benign_prob: Column, attack_prob: Column) -> Column:
    """probability of the predicted side as a percent text with 2 decimals."""
    p = F.when(is_attack, attack_prob).otherwise(benign_prob)
    return F.format_string("%.2f%%", p * 100)


def fmt2(c: Column) -> Column:
    """floats as '%.2f'."""
    return F.format_string("%.2f", c)


def value_text(c: Column, type_name: str) -> Column:
    """F6 by the column's type: floats as '%.2f', integers and other values as they are, null as null."""
    return F.when(c.isNotNull(), fmt2(c) if type_name in ("float", "double") else c.cast("string"))


def prettify(c: Column) -> Column:
    """'_' -> ' ' then title case: a letter after a non-letter is upper, the rest lower."""
    runs = F.regexp_extract_all(F.lower(F.regexp_replace(c, "_", " ")), F.lit(r"(\p{L}+|\P{L}+)"), 1)
    return F.array_join(F.transform(runs, lambda r: F.concat(F.upper(F.substring(r, 1, 1)),
                                                             F.substring(r, 2, 1 << 30))), "")


def usable(*probs: Column) -> Column:
    """Whether all probabilities are there and finite."""
    ok = F.lit(True)
    for p in probs:
        ok = ok & p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
    return F.coalesce(ok, F.lit(False))


def interpretation(is_attack: Column, attack: Column, model: Column) -> Column:
    """F8: the interpretation sentence."""
    verdict = F.when(is_attack, F.lit("Harmful")).otherwise(F.lit("Benign"))
    kind = F.when(is_attack, attack).otherwise(F.lit(fixed.NOT_ATTACK))
    head, rest = fixed.INTERPRETATION.split("{verdict}")
    mid, rest = rest.split("{attack}")
    mid2, tail = rest.split("{model}")
    return F.concat(F.lit(head), verdict, F.lit(mid), kind, F.lit(mid2), model, F.lit(tail))


def characteristics(attack: Column, is_attack: Column) -> Column:
    """characteristics text by attack display name; NULL for benign rows."""
    m = F.create_map(*[F.lit(x) for pair in fixed.CHARACTERISTICS for x in pair])
    return F.when(is_attack, F.coalesce(F.try_element_at(m, attack),
                                        F.lit(fixed.CHARACTERISTICS_DEFAULT)))


def recommendations(is_attack: Column) -> Column:
    """array of recommendation texts (5 for an attack, 1 for benign)."""
    return F.when(is_attack, F.array(*[F.lit(t) for t in fixed.ATTACK_RECOMMENDATIONS])
                  ).otherwise(F.array(*[F.lit(t) for t in fixed.BENIGN_RECOMMENDATIONS]))


def signed_log(c: Column) -> Column:
    """sign(x) * log1p(|x|)."""
    return F.signum(c) * F.log1p(F.abs(c))


def ratio(a: Column, b: Column, eps: float = fixed.RATIO_EPS) -> Column:
    """a / (b + eps), NULL instead of an error on a zero denominator."""
    return F.try_divide(a, b + F.lit(eps))


def row_mean(cols: Sequence[Column]) -> Column:
    """mean of the row's values (inputs are cleaned: no NULLs)."""
    total = cols[0]
    for c in cols[1:]:
        total = total + c
    return total / F.lit(float(len(cols)))


def row_std(cols: Sequence[Column]) -> Column:
    """F16: population std of the original columns (what ddof=1 over originals + mean gives)."""
    mean = row_mean(cols)
    ss = None
    for c in cols:
        d = (c - mean) * (c - mean)
        ss = d if ss is None else ss + d
    return F.sqrt(ss / F.lit(float(len(cols))))
