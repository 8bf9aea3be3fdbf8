"""Operator 12, embedding whitening by FEAST contour integration.

Vectors are read as whole numbers ``x = floor(1024 * c) + 100000``; sums are exact, the
covariance is centred before multiplying and added up in tasks (one d x d matrix each).

The leading eigenvectors of the d x d covariance come from FEAST: an interval that holds
them is chosen by inertia counts; Gauss-Legendre quadrature of complex shifted solves
``(zI - V)^-1 Q`` along the upper half of a circle round the interval projects a block of
vectors onto the interval's eigenspace; Rayleigh-Ritz extracts the components; the step is
repeated until residuals are at rounding level. Inertia counts at the interval's ends must
equal the number of Ritz values inside, else the block is widened and the search repeated.

Defined results: rows whose vector is null or holds null or non-finite entries take no part,
nor do vectors of another length than most (ties: the shorter) or with an entry whose x does
not fit a long (beyond 2**52). Null and repeated ids are kept row by row; an empty table gives no
rows. Components whose eigenvalue is below ``FLAT`` of the largest have null ``whitened``
and stay out of the identity error; a table of equal vectors has ``explained`` 0.
``deviation`` is a decimal(38, 0) (null beyond it); the query casts it to a long (null
where it does not fit). Columns other than the id and the vector are not read.
"""

from __future__ import annotations

import decimal
import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.llm import common as C

COMPONENTS = 8
SCALE, SHIFT = 1024, 100000
NODES, ROUNDS, RESIDUAL, FLAT = 8, 60, 1e-14, 1e-13
MOST_ENTRY = float(1 << 52)


# --- eigenpairs of one symmetric matrix -------------------------------------------------

class Inertia:
    """Counts of eigenvalues below a shift: signs of the LDL' pivots of the tridiagonal form."""

    def __init__(self, v: np.ndarray):
        a, d = v.copy(), len(v)
        for k in range(d - 2):
            x = a[k + 1:, k]
            alpha = -np.copysign(np.linalg.norm(x), x[0])
            u = x.copy()
            u[0] -= alpha
            size = u @ u
            if size > 0:
                w = a[k + 1:, k + 1:] @ u * (2 / size)
                w -= u * (w @ u / size)
                a[k + 1:, k + 1:] -= np.outer(u, w) + np.outer(w, u)
                a[k + 1:, k] = a[k, k + 1:] = 0
                a[k + 1, k] = a[k, k + 1] = alpha
        self.diagonal, self.beside = np.diag(a).copy(), np.diag(a, 1) ** 2
        self.scale = max(float(np.abs(v).sum(axis=1).max()), np.finfo(float).tiny) if d else 1.0

    def below(self, shift: float) -> int:
        """How many eigenvalues are smaller than ``shift``."""
        count, pivot, tiny = 0, 1.0, self.scale * 1e-290
        for k, value in enumerate(self.diagonal):
            pivot = value - shift - (self.beside[k - 1] / pivot if k else 0.0)
            if abs(pivot) < tiny:
                pivot = -tiny
            count += pivot < 0
        return count

    def eigenvalue(self, k: int) -> float:
        """The k-th largest eigenvalue (from 1) by bisection."""
        low, high, rank = -self.scale, self.scale, len(self.diagonal) - k
        for _ in range(80):
            mid = (low + high) / 2
            if self.below(mid) > rank:
                high = mid
            else:
                low = mid
        return (low + high) / 2


def leading_interval(inertia: Inertia, wanted: int) -> tuple[float, float, int]:
    """(low, high, count): an interval of the ``wanted`` largest eigenvalues, with those that
    cannot be told from the last of them; low lies in a gap of the spectrum."""
    d, scale = len(inertia.diagonal), inertia.scale
    high = inertia.eigenvalue(1) + scale * 1e-2
    last = inertia.eigenvalue(wanted)
    for k in range(wanted, d):
        following = inertia.eigenvalue(k + 1)
        if last - following > scale * 1e-12:
            return (last + following) / 2, high, k
        last = following
    return last - scale * 1e-2, high, d


def feast(v: np.ndarray, low: float, high: float, inertia: Inertia, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """All eigenvalues of ``v`` in [low, high], falling, and their unit eigenvectors."""
    d = len(v)
    inside = inertia.below(high) - inertia.below(low)
    node, weight = np.polynomial.legendre.leggauss(NODES)
    turn = np.exp(1j * np.pi / 2 * (1 + node))
    centre, radius = (low + high) / 2, (high - low) / 2
    size, best = min(d, inside + max(4, inside // 2)), None
    while True:
        q = np.random.default_rng(seed).normal(size=(d, size))
        for _ in range(ROUNDS):
            projected = np.zeros((d, size))
            for z, w in zip(turn, weight, strict=True):
                solved = np.linalg.solve((centre + radius * z) * np.eye(d) - v, q.astype(complex))
                projected += w / 2 * (radius * z * solved).real
            basis, _ = np.linalg.qr(projected)
            values, turned = np.linalg.eigh(basis.T @ v @ basis)      # Rayleigh-Ritz
            q = basis @ turned
            mine = (values >= low) & (values <= high)
            residual = np.abs(v @ q[:, mine] - q[:, mine] * values[mine]).max(initial=0.0)
            if mine.sum() == inside and (best is None or residual < best[0]):
                best = residual, values[mine][::-1], q[:, mine][:, ::-1]
            if mine.sum() == inside and residual <= RESIDUAL * inertia.scale:
                return best[1:]
        # no eigenvalue may be missing: the inertia counts settle it
        if best is not None and best[0] <= 1e-11 * inertia.scale:
            return best[1:]
        if size == d:
            raise ArithmeticError(f"found no {inside} eigenvalues between {low} and {high}")
        size = min(d, 2 * size)


def components(v: np.ndarray, wanted: int) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues, unit eigenvectors as columns) of the largest ``wanted`` components."""
    wanted = min(wanted, len(v))
    total = np.trace(v)
    if not wanted or not total > 0:
        return np.zeros(wanted), np.eye(len(v))[:, :wanted]
    scaled = v / total
    inertia = Inertia(scaled)
    low, high, count = leading_interval(inertia, wanted)
    values, vectors = feast(scaled, low, high, inertia)
    if len(values) != count:
        raise ArithmeticError("inertia counts and Ritz values differ")
    return np.maximum(values[:wanted], 0) * total, vectors[:, :wanted]


# --- distributed parts ------------------------------------------------------------------

def usable(df: DataFrame, id_col: str, vec_col: str) -> tuple[DataFrame, int]:
    """Rows (id, v) that take part, and their length (0: none)."""
    rows = df.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{vec_col}`").cast("array<double>").alias("v"))
    bad = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) > MOST_ENTRY))
    rows = rows.where(F.col("v").isNotNull() & (F.size("v") > 0) & ~bad)
    most = (rows.groupBy(F.size("v").alias("d")).count()
            .orderBy(F.desc("count"), "d").first())
    d = most["d"] if most else 0
    return rows.where(F.size("v") == d), d


def _whole(batch: pa.RecordBatch, d: int) -> np.ndarray:
    flat = batch["v"].flatten().to_numpy(zero_copy_only=False)
    return (np.floor(SCALE * flat).astype(np.int64) + SHIFT).reshape(-1, d)


def exact_sums(rows: DataFrame, d: int) -> tuple[int, list[int]]:
    """(rows, exact sum of x per dimension)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, high, low = 0, np.zeros(d, np.int64), np.zeros(d, np.int64)
        for batch in batches:
            x = _whole(batch, d)
            n += len(x)
            high += (x >> 32).sum(axis=0)
            low += (x & 0xFFFFFFFF).sum(axis=0)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(d)), pa.array(np.full(d, n)), pa.array(high),
                                              pa.array(low)], names=["dim", "n", "high", "low"])

    wide = [F.sum(F.col(c).cast("decimal(28,0)")).alias(c) for c in ("high", "low")]
    parts = (rows.select("v").mapInArrow(run, "dim long, n long, high long, low long")
             .groupBy("dim").agg(F.sum("n").alias("n"), *wide).orderBy("dim").collect())   # d rows
    return (parts[0]["n"], [(int(p["high"]) << 32) + int(p["low"]) for p in parts]) if parts else (0, [])


def covariance(rows: DataFrame, d: int, n: int, mean: np.ndarray) -> np.ndarray:
    """d x d covariance with divisor n, centred before multiplying."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((d, d))
        for batch in batches:
            x = _whole(batch, d) - mean
            total += x.T @ x
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(np.arange(d), d)), pa.array(np.tile(np.arange(d), d)), pa.array(total.ravel())],
            names=["i", "j", "s"])

    cells = (rows.select("v").mapInArrow(run, "i long, j long, s double")
             .groupBy("i", "j").agg(F.sum("s").alias("s")).toPandas())                     # d * d rows
    out = np.zeros((d, d))
    out[cells["i"], cells["j"]] = cells["s"] / n
    return (out + out.T) / 2


def project(rows: DataFrame, d: int, n: int, sums: list[int], values: np.ndarray, vectors: np.ndarray) -> DataFrame:
    """(id, deviation, whitened) of every row."""
    mean = np.array([s / n for s in sums])
    live = values > FLAT * values.max(initial=0.0)
    turn = vectors[:, live] / np.sqrt(values[live])
    exact = np.array(sums, dtype=object)
    largest = max(map(abs, sums), default=0)

    def deviations(x: np.ndarray) -> list[int]:
        reach = n * int(np.abs(x).max(initial=0)) + largest
        if reach < 1 << 62:
            y = n * x - exact.astype(np.int64)
            if int(np.abs(y).max(initial=0)) ** 2 * d < 1 << 63:
                return (y * y).sum(axis=1).tolist()
        y = n * x.astype(object) - exact
        return (y * y).sum(axis=1).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        limit = 10 ** 38
        with decimal.localcontext(prec=60):
            for batch in batches:
                x = _whole(batch, d)
                out = np.full((len(x), len(values)), np.nan)
                out[:, live] = (x - mean) @ turn
                flat = pa.array(out.ravel(), from_pandas=True)
                whitened = pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(values), flat)
                away = pa.array([decimal.Decimal(v) if v < limit else None for v in deviations(x)],
                                pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([batch["id"], away, whitened], names=["id", "deviation", "whitened"])

    schema = T.StructType([T.StructField("id", rows.schema["id"].dataType),
                           T.StructField("deviation", T.DecimalType(38, 0)),
                           T.StructField("whitened", T.ArrayType(T.DoubleType()))])
    return rows.mapInArrow(run, schema)


def identity_error(white: DataFrame, live: list[int]) -> float:
    """Largest absolute entry of the whitened covariance minus the identity."""
    pairs = list(itertools.combinations_with_replacement(live, 2))
    if not pairs:
        return 0.0
    w = F.col("whitened")
    found = white.agg(*[F.covar_pop(w[i], w[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(value - (i == j)) for value, (i, j) in zip(found, pairs, strict=True))


def whiten(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", wanted: int = COMPONENTS
           ) -> tuple[DataFrame, dict]:
    """(id, deviation, whitened) of every row that takes part, and what was learned: n, sums,
    eigenvalues, vectors, explained shares and the identity error over all rows."""
    rows, d = usable(df, id_col, vec_col)
    n, sums = exact_sums(rows, d) if d else (0, [])
    mean = np.array([s / n for s in sums]) if n else np.zeros(0)
    v = covariance(rows, d, n, mean) if n else np.zeros((0, 0))
    values, vectors = components(v, wanted)
    total = float(np.trace(v))
    white = C.staged(project(rows, max(d, 1), max(n, 1), sums or [0], values, vectors), "whitened")
    live = [int(k) for k in np.flatnonzero(values > FLAT * values.max(initial=0.0))]
    return white, {"n": n, "sums": sums, "eigenvalues": values, "vectors": vectors,
                   "explained": [float(e) / total if total > 0 else 0.0 for e in values],
                   "identity_error": identity_error(white, live)}


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op12: whitened coordinates of every embedding, one row per component."""
    white, found = whiten(C.table(spark, sf_dir, "embeddings"))
    share = F.array(*[F.lit(e) for e in found["explained"]]).cast("array<double>")
    rows = white.select(F.col("id").alias("vec_id"), F.expr("try_cast(deviation as bigint)").alias("deviation"),
                        F.posexplode("whitened").alias("at", "whitened"))
    return rows.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(found["n"]).cast("long").alias("n"),
                       "deviation", "whitened", F.get(share, F.col("at")).alias("explained"),
                       F.lit(float(found["identity_error"])).alias("identity_error"))
