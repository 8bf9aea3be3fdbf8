"""Bin edges of feature vectors from all rows (boosting, forests).

A quantile lies between two order statistics. These are found digit by digit of the values' sortable bits: each
pass counts, in every task, the next ``DIGIT`` bits of the values that share the digits found so far, and sums
the counts by feature. The edges are those of ``numpy.quantile`` over the whole column, whatever its length, and no
task or driver holds a column.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DIGIT = 9
FIRST = np.uint64(1 << 63)


def sortable(x: np.ndarray) -> np.ndarray:
    """Whole numbers in the order of the values."""
    bits = np.ascontiguousarray(x + 0.0).view(np.uint64)
    return np.where(bits >= FIRST, ~bits, bits | FIRST)


def value(keys: np.ndarray) -> np.ndarray:
    return np.where(keys >= FIRST, keys & ~FIRST, ~keys).astype(np.uint64).view(float)


def _columns(batch: pa.RecordBatch, width: int) -> np.ndarray:
    x = batch["x"].flatten().to_numpy(zero_copy_only=False).reshape(-1, width)
    return np.ascontiguousarray(x.T, dtype=float)


def edges(df: DataFrame, width: int, bins: int, halfway: bool) -> list[np.ndarray]:
    """Inner edges of at most ``bins`` bins for each place of the vectors ``x``: quantiles of the finite values; with
    ``halfway``, features of at most ``bins`` values get edges half way between them."""
    def told(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, seen, bits = np.zeros(width, np.int64), [np.zeros(0)] * width, 0
        for batch in batches:
            for f, column in enumerate(_columns(batch, width)):
                good = column[np.isfinite(column)] + 0.0
                n[f] += len(good)
                bits |= int(np.bitwise_or.reduce(good.view(np.uint64), initial=np.uint64(0)))
                if len(seen[f]) <= bins:
                    seen[f] = np.unique(np.concatenate([seen[f], good]))[:bins + 1]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array(n), pa.array(seen, pa.list_(pa.float64())),
                                          pa.array([bits & (1 << 63) - 1] * width, pa.int64())], names=["f", "n", "seen", "bits"])

    x = df.select("x")
    first = {r.f: r for r in x.mapInArrow(told, "f int, n long, seen array<double>, bits long").groupBy("f").agg(
        F.sum("n").alias("n"), F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("seen")))), 1, bins + 1).alias("seen"),
        F.bit_or("bits").alias("bits")).collect()}                       # a row per feature
    n = np.array([first[f].n if f in first else 0 for f in range(width)])
    few = [np.array(first[f].seen if f in first else []) for f in range(width)]
    bits = reduce(or_, (first[f].bits for f in first), 0)
    low = (bits & -bits).bit_length() - 1 if bits else 63                # bits that are 0 in every value
    at = np.linspace(0, 1, bins + 1)[1:-1]
    places = [at * (m - 1) if m and not (halfway and len(v) <= bins) else np.zeros(0) for m, v in zip(n, few, strict=True)]
    ranks = [np.unique(np.concatenate([np.floor(p), np.minimum(np.floor(p) + 1, m - 1)])).astype(np.int64) for p, m in zip(places, n, strict=True)]
    found = _order_statistics(x, width, ranks, low)
    out = []
    for f, (p, m) in enumerate(zip(places, n, strict=True)):
        if halfway and len(few[f]) <= bins:
            out.append(few[f][:-1] + np.diff(few[f]) / 2)
            continue
        below = np.floor(p)
        a, b = (found[f][np.searchsorted(ranks[f], np.minimum(r, m - 1))] for r in (below, below + 1))
        t, by = p - below, b - a
        out.append(np.unique(np.where(t >= 0.5, b - by * (1 - t), a + by * t)))
    return out


def _chosen(state: list[tuple], size: int) -> Callable[[tuple, pa.Table], pa.Table]:
    """The next digit of each value that is sought, from a feature's summed counts, and the values before it."""
    def chosen(key: tuple, table: pa.Table) -> pa.Table:
        wanted, known, passed = state[f := key[0].as_py()]
        sums = sum(np.frombuffer(p, np.int64) for p in table["part"].to_pylist()).reshape(-1, 1 << size).cumsum(axis=1)
        row = np.searchsorted(np.unique(known), known)
        digit = np.array([np.searchsorted(sums[r], w, "right") for r, w in zip(row, wanted - passed, strict=True)], np.int64)
        if len(row):
            passed = passed + np.where(digit > 0, sums[row, np.maximum(digit - 1, 0)], 0)
        return pa.table({"f": pa.array([f], pa.int32()), "digit": pa.array([digit], pa.list_(pa.int64())),
                         "passed": pa.array([passed], pa.list_(pa.int64()))})
    return chosen


def _order_statistics(x: DataFrame, width: int, ranks: list[np.ndarray], low: int) -> list[np.ndarray]:
    """The finite values at these places (from 0) of each feature's order."""
    digits = [np.zeros(len(r), np.uint64) for r in ranks]
    before = [np.zeros(len(r), np.int64) for r in ranks]
    done = 0
    while done < 64 - low and any(map(len, ranks)):
        size = min(DIGIT, 64 - done)
        shared = x.sparkSession.sparkContext.broadcast([np.unique(d) for d in digits])
        first, last = 64 - done, np.uint64(64 - done - size)

        def counted(batches: Iterator[pa.RecordBatch], first=first, last=last, size=size, shared=shared) -> Iterator[pa.RecordBatch]:
            sums = [np.zeros((len(p), 1 << size), np.int64) for p in shared.value]
            for batch in batches:
                for one, known, column in zip(sums, shared.value, _columns(batch, width), strict=True):
                    if len(known):
                        keys = sortable(column[np.isfinite(column)])
                        above = keys >> np.uint64(first) if first < 64 else np.zeros(len(keys), np.uint64)
                        place = np.minimum(np.searchsorted(known, above), len(known) - 1)
                        mine = known[place] == above
                        digit = (keys[mine] >> last).astype(np.int64) & (1 << size) - 1
                        one += np.bincount(place[mine] << size | digit, minlength=one.size).reshape(one.shape)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(width, dtype=np.int32)), pa.array([s.tobytes() for s in sums], pa.binary())],
                                             names=["f", "part"])

        for r in x.mapInArrow(counted, "f int, part binary").groupBy("f").applyInArrow(
                _chosen(list(zip(ranks, digits, before, strict=True)), size), "f int, digit array<long>, passed array<long>").collect():
            digits[r.f] = digits[r.f] << np.uint64(size) | np.array(r.digit, np.uint64)
            before[r.f] = np.array(r.passed, np.int64)
        shared.destroy()
        done += size
    rest = 64 - done
    out = []
    for d in digits:                                                     # what is left is 0 in every value
        keys = d << np.uint64(rest) if rest < 64 else d
        out.append(value(np.where(keys >= FIRST, keys, keys | np.uint64((1 << rest) - 1))))
    return out
