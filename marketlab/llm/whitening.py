"""Whitening of embeddings: pivoted Cholesky of the centred scatter, one-sided Jacobi on its factor.

Vectors become integers ``x = floor(256 * entry)``. The fit list holds each
distinct x once, found by a distributed distinct. Tasks reduce it to sums and to
one scatter matrix per task, summed by cell; the driver sees matrices of
dimension squared, never rows.

Scatter: entries are centred at the integer next to the mean before they are
multiplied, so products and their sums are whole numbers, exact and free of order
below 2^53; the rest of the centring, less than half a unit, is taken off by the
exact sums. The scatter A is factored as P'AP = LL' with diagonal pivoting, which
ends at the numerical rank. Plane rotations from the right make the columns of L
orthogonal; as LL' stays the same, squared column norms are the eigenvalues of A
and normalised columns its eigenvectors, with high relative accuracy.

Defined results: rows whose vector is null, or holds nulls or entries that are
not finite, are dropped. The commonest length of the others is the dimension (the
longest of equally common ones); rows of another length are dropped. Repeated
rows give repeated results and count once in the fit. Null ids are ordinary
values. There are at most as many components as the rank of the fit list, so one
distinct vector, or none, gives no rows. A component's largest entry is positive.
``deviation`` is null where it exceeds a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from marketlab.llm.common import forget, stored

SCALE = 256
COMPONENTS = 4
_EXACT = 1 << 26  # squares of such entries add up inside a long


@dataclass(frozen=True)
class Whitening:
    """A fit: n distinct vectors with sums per dimension, eigenvalues and components (rows) by falling eigenvalue."""

    n: int
    sums: tuple[int, ...]
    values: np.ndarray
    components: np.ndarray
    trace: float

    @property
    def mean(self) -> np.ndarray:
        return np.array([s / self.n for s in self.sums])


def integer_vectors(vectors: DataFrame, column: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """Valid rows: ``keep`` columns and x as array of long."""
    c = F.col(column)
    whole = c.isNotNull() & (F.size(c) > 0) & F.forall(c, lambda e: e.isNotNull() & ~F.isnan(e.cast("double")) & (F.abs(e.cast("double")) < float("inf")))
    return vectors.where(F.coalesce(whole, F.lit(False))).select(*keep, F.transform(c, lambda e: F.floor(e.cast("double") * SCALE)).alias("x"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), np.int64).reshape(-1, dim)


def column_sums(x: np.ndarray) -> list[int]:
    small = x.size == 0 or int(np.abs(x).max()) < _EXACT
    return (x if small else x.astype(object)).sum(0).tolist()


def totals(fit: DataFrame, dim: int) -> tuple[int, tuple[int, ...]]:
    """Row count and exact sums per dimension."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, s = 0, [0] * dim
        for batch in batches:
            n += batch.num_rows
            s = [a + b for a, b in zip(s, column_sums(matrix(batch.column("x"), dim)))] if batch.num_rows else s
        yield pa.RecordBatch.from_arrays([pa.array(range(-1, dim), pa.int32()), pa.array([str(v) for v in (n, *s)])], names=["i", "s"])

    rows = fit.select("x").mapInArrow(run, "i int, s string").groupBy("i").agg(F.sum(F.col("s").cast("decimal(38,0)")).alias("s")).collect()
    found = {r["i"]: int(r["s"]) for r in rows}
    return found.get(-1, 0), tuple(found.get(i, 0) for i in range(dim))


def summed_products(fit: DataFrame, dim: int, side: int, project) -> np.ndarray:
    """Sum of y'y over the rows, y = project(x) with a leading column of ones: (side + 1) squared, one matrix per task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = np.zeros((side + 1, side + 1))
        for batch in batches:
            y = project(matrix(batch.column("x"), dim))
            y = np.concatenate([np.ones((len(y), 1)), y], 1)
            m += y.T @ y
        i, j = np.triu_indices(side + 1)
        yield pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m[i, j], pa.float64())], names=["i", "j", "v"])

    cells = fit.select("x").mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).toPandas()
    m = np.zeros((side + 1, side + 1))
    m[cells["i"], cells["j"]] = cells["v"]
    m[cells["j"], cells["i"]] = cells["v"]
    return m


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """Lower trapezoidal factor with rows in the order of ``a``: a = f f', as many columns as the numerical rank."""
    a, d = a.copy(), len(a)
    order, f = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    rank = 0
    for k in range(d):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if a[p, p] <= least:
            break
        for m in (a, a.T, f, order):
            m[[k, p]] = m[[p, k]]
        f[k, k] = np.sqrt(a[k, k])
        f[k + 1 :, k] = a[k + 1 :, k] / f[k, k]
        a[k + 1 :, k + 1 :] -= np.outer(f[k + 1 :, k], f[k + 1 :, k])
        rank += 1
    out = np.zeros((d, rank))
    out[order] = f[:, :rank]
    return out


def jacobi_columns(factor: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """Columns made orthogonal by plane rotations from the right; disjoint pairs of a round turn at once."""
    g, r = factor.copy(), factor.shape[1]
    if r < 2:
        return g
    if r % 2:
        g = np.concatenate([g, np.zeros((len(g), 1))], 1)
    seat = np.arange(g.shape[1])
    half = len(seat) // 2
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(len(seat) - 1):
            p, q = seat[:half], seat[half:][::-1]
            u, v = g[:, p], g[:, q]
            uu, vv, uv = (u * u).sum(0), (v * v).sum(0), (u * v).sum(0)
            scale = np.sqrt(uu * vv)
            turn = np.abs(uv) > 1e-16 * scale
            worst = max(worst, float((np.abs(uv) / np.where(scale > 0, scale, 1.0)).max()))
            z = np.where(turn, (vv - uu) / (2 * np.where(turn, uv, 1.0)), 0.0)
            t = np.where(turn, np.where(z >= 0, 1.0, -1.0) / (np.abs(z) + np.hypot(1.0, z)), 0.0)
            c = 1 / np.hypot(1.0, t)
            g[:, p], g[:, q] = c * (u - t * v), c * (v + t * u)
            seat = np.concatenate([seat[:1], seat[-1:], seat[1:-1]])
        if worst < 1e-15:
            break
    return g[:, :r] if r == factor.shape[1] else g


def fit_whitening(distinct: DataFrame, dim: int, components: int = COMPONENTS) -> Whitening | None:
    """Fit to ``distinct(x)``; None without rows."""
    n, sums = totals(distinct, dim)
    if n == 0:
        return None
    near = [(2 * s + n) // (2 * n) for s in sums]  # integers next to the means
    shift = np.array(near, np.int64)
    m = summed_products(distinct, dim, dim, lambda x: (x - shift).astype(np.float64))
    rest = np.array([s - n * a for s, a in zip(sums, near)], np.float64)
    scatter = m[1:, 1:] - np.outer(rest, rest) / n
    g = jacobi_columns(pivoted_cholesky(scatter))
    norms = np.sqrt((g * g).sum(0))
    order = [i for i in np.argsort(-norms, kind="stable") if norms[i] > 0][:components]
    vectors = (g[:, order] / norms[order]).T
    big = np.abs(vectors).argmax(1) if len(order) else []
    vectors = vectors * np.array([1.0 if v[b] > 0 else -1.0 for v, b in zip(vectors, big)]).reshape(-1, 1)
    return Whitening(n, sums, norms[order] ** 2 / n, vectors, float(np.trace(scatter)) / n)


def projector(fit: Whitening):
    """x to whitened values, one column per component."""
    mean, weights = fit.mean, (fit.components / np.sqrt(fit.values)[:, None]).T
    return lambda x: (x - mean) @ weights


def identity_error(distinct: DataFrame, fit: Whitening) -> float:
    """Largest absolute entry of the whitened fit list's covariance minus the identity."""
    k = len(fit.values)
    m = summed_products(distinct, len(fit.sums), k, projector(fit))
    cov = m[1:, 1:] / fit.n - np.outer(m[0, 1:], m[0, 1:]) / fit.n**2
    return float(np.abs(cov - np.eye(k)).max(initial=0.0))


def whiten(vectors: DataFrame, column: str = "embedding", keep: tuple[str, ...] = ("vec_id",), components: int = COMPONENTS) -> DataFrame:
    """Per row and component: ``keep``, component, n, deviation, whitened, explained, identity_error, eigenvalue."""
    rows = integer_vectors(vectors, column, keep)
    types = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    kept = "".join(f"`{k}` {types[k]}, " for k in keep)
    common = rows.groupBy(F.size("x").alias("d")).agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), F.desc("d")).first()
    dim = common["d"] if common else 0
    rows = rows.where(F.size("x") == dim)
    fit, error = None, 0.0
    if dim:
        distinct = stored(rows.select("x").distinct())
        fit = fit_whitening(distinct, dim, components)
        error = identity_error(distinct, fit)
        forget(distinct)
    n, sums = (fit.n, fit.sums) if fit else (0, ())
    squares = sum(s * s for s in sums)
    small = max((abs(s) for s in sums), default=0) * max(dim, 1) < 1 << 36

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        project, s = projector(fit), np.array(sums, np.int64 if small else object)
        for batch in batches:
            x = matrix(batch.column("x"), dim)
            exact = x if small and (x.size == 0 or int(np.abs(x).max()) < _EXACT) else x.astype(object)
            own, cross = (exact * exact).sum(1).tolist(), (exact * s).sum(1).tolist()
            dev = [n * n * int(q) - 2 * n * int(r) + squares for q, r in zip(own, cross)]
            dev = pa.array([v if v < 1 << 63 else None for v in dev], pa.int64())
            w = project(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel(), pa.float64()))
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keep), dev, lists], names=[*keep, "deviation", "w"])

    out = rows.mapInArrow(run, f"{kept}deviation long, w array<double>") if fit else rows.select(*keep, F.lit(0).cast("long").alias("deviation"), F.array().cast("array<double>").alias("w")).where("false")
    parts = [float(v / fit.trace) for v in fit.values] if fit and fit.trace > 0 else []
    values = [float(v) for v in fit.values] if fit else []
    numbers = lambda v: F.array(*[F.lit(e) for e in v]).cast("array<double>")
    long = out.select(*keep, "deviation", F.posexplode("w").alias("_p", "whitened"))
    return long.select(
        *keep,
        (F.col("_p") + 1).alias("component"),
        F.lit(n).cast("long").alias("n"),
        "deviation",
        "whitened",
        F.get(numbers(parts), F.col("_p")).alias("explained"),
        F.lit(error).alias("identity_error"),
        F.get(numbers(values), F.col("_p")).alias("eigenvalue"),
    )
