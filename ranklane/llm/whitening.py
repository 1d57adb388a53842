"""Embedding whitening by pivoted Cholesky and one-sided Jacobi.

Vectors become integers, ``floor(SCALE * c) + OFFSET``, and all sums over the
table are sums of integers, so no result depends on how rows are dealt:

1. count and per-dimension sums;
2. the scatter of what is left after taking off each dimension's mean, rounded
   to an integer; the rest of the mean, under one half, is taken off the small
   matrix exactly. Tasks sum products of small integers and send a
   row for each pair of dimensions; Spark adds them up;
3. the whitened rows, written once, and the covariance they really have.

The covariance (dimensions squared, whatever the number of rows) is factored on
the driver: Cholesky with complete pivoting, ``P V P' = L L'``, ends at the
numerical rank; one-sided Jacobi then rotates pairs of columns of the
triangular factor until all are orthogonal. A rotated column's squared norm is
an eigenvalue and the normalised column its component. The covariance's own
condition is never squared, so small components are as good as large ones.

Defined cases: a null vector, and one with a null, NaN or infinite entry, is
dropped; so are vectors of another length than the most frequent one (of equal
counts the longest) and empty vectors; integers are kept within ``LIMIT``; a
deviation of more than 38 digits is null; rows that share an id, or have none,
are rows of their own; components of no
variance (a column of one value, fewer rows than components) are not returned.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ranklane.llm.common import written

SCALE = 1024
OFFSET = 100_000
#: largest absolute integer of an entry
LIMIT = 1 << 46
COMPONENTS = 8
#: numbers of a batch that are worked on at once
_NUMBERS = 1 << 20


def _matrices(batches: Iterator[pa.RecordBatch], dims: int) -> Iterator[tuple[pa.Array, np.ndarray]]:
    """(ids, integer vectors) of the rows that remain, in pieces."""
    rows = max(1, _NUMBERS // dims)
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            part = batch.slice(at, rows)
            vectors = part.column(1)
            right = np.asarray(vectors.value_lengths().fill_null(-1)) == dims
            part = part.filter(pa.array(right))
            c = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            keep = np.isfinite(c).all(axis=1)  # a null entry is NaN here
            with np.errstate(over="ignore"):
                x = np.clip(np.floor(c[keep] * SCALE), -LIMIT, LIMIT).astype(np.int64) + OFFSET
            if len(x):
                yield part.column(0).filter(pa.array(keep)), x


def _products(y: np.ndarray) -> np.ndarray:
    """y'y of integers, exact: by floating point where every sum is below 2**53."""
    most = int(np.abs(y).max(initial=0))
    if most * most * len(y) < 1 << 53:
        f = y.astype(np.float64)
        return (f.T @ f).astype(np.int64).astype(object)
    return y.astype(object).T @ y.astype(object)


def _summed(rows: DataFrame) -> dict[tuple[int, int], int]:
    """(i, j) -> sum of a table of (i, j, s): as many rows as the matrix has entries."""
    found = rows.groupBy("i", "j").agg(F.sum("s").alias("s")).collect()
    return {(r.i, r.j): int(r.s) for r in found}


def _entries(entries: dict[tuple[int, int], int]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([k[0] for k in entries], pa.int32()), pa.array([k[1] for k in entries], pa.int32()),
         pa.array([Decimal(v) for v in entries.values()], pa.decimal128(38, 0))], ["i", "j", "s"])


def sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    """(rows, sum of each dimension) of the remaining vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for _, x in _matrices(batches, dims):
            n += len(x)
            small = int(np.abs(x).max()) * len(x) < 1 << 62
            total += x.sum(axis=0).astype(object) if small else x.astype(object).sum(axis=0)
        yield _entries({(-1, -1): n} | {(i, -1): int(s) for i, s in enumerate(total)})

    found = _summed(vectors.mapInArrow(run, "i int, j int, s decimal(38,0)"))
    return found.get((-1, -1), 0), [found.get((i, -1), 0) for i in range(dims)]


def covariance(vectors: DataFrame, n: int, totals: list[int]) -> np.ndarray:
    """Covariance with divisor ``n``, each entry the double nearest to the true one."""
    dims = len(totals)
    means = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = [s - n * int(m) for s, m in zip(totals, means)]  # what the rounded means leave, times n
    low = np.tril_indices(dims)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dims, dims), object)
        for _, x in _matrices(batches, dims):
            total += _products(x - means)
        for lo in range(0, len(low[0]), _NUMBERS):
            some = [(int(i), int(j)) for i, j in zip(low[0][lo:lo + _NUMBERS], low[1][lo:lo + _NUMBERS])]
            yield _entries({k: int(total[k]) for k in some})

    found = _summed(vectors.mapInArrow(run, "i int, j int, s decimal(38,0)"))
    out = np.zeros((dims, dims))
    for (i, j), s in found.items():
        out[i, j] = out[j, i] = float(Fraction(n * s - rest[i] * rest[j], n * n))
    return out


def pivoted_cholesky(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(factor, order): ``v[order][:, order]`` is factor times its transpose.
    The factor has a column for each pivot above rounding error."""
    a, d = v.copy(), len(v)
    order, factor = np.arange(d), np.zeros((d, d))
    least = np.finfo(float).eps * d * max(0.0, np.diag(v).max(initial=0.0))
    for k in range(d):
        p = k + int(np.argmax(np.diag(a)[k:]))
        if a[p, p] <= least:
            return factor[:, :k], order
        for x in (a, a.T, factor, order):
            x[[k, p]] = x[[p, k]]
        factor[k, k] = math.sqrt(a[k, k])
        factor[k + 1:, k] = a[k + 1:, k] / factor[k, k]
        a[k + 1:, k + 1:] -= np.outer(factor[k + 1:, k], factor[k + 1:, k])
    return factor, order


def _rounds(n: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Pairs of columns, in rounds without a common column, each pair once."""
    ring = list(range(n + n % 2))
    out = []
    for _ in range(len(ring) - 1):
        half = len(ring) // 2
        pairs = [(min(a, b), max(a, b)) for a, b in zip(ring[:half], ring[:half - 1:-1]) if max(a, b) < n]
        out.append((np.array([p for p, _ in pairs], int), np.array([q for _, q in pairs], int)))
        ring = [ring[0], ring[-1], *ring[1:-1]]
    return out


def one_sided_jacobi(factor: np.ndarray, max_sweeps: int = 60) -> np.ndarray:
    """The factor with its columns rotated, pair by pair, until all are orthogonal."""
    g = factor.copy()
    tolerance = np.finfo(float).eps * max(1, len(g)) ** 0.5
    rounds = _rounds(g.shape[1])
    for _ in range(max_sweeps):
        worst = 0.0
        for p, q in rounds:
            a, b = g[:, p], g[:, q]
            alpha, beta, gamma = (a * a).sum(axis=0), (b * b).sum(axis=0), (a * b).sum(axis=0)
            scale = np.sqrt(alpha * beta)
            off = np.divide(np.abs(gamma), scale, out=np.zeros_like(gamma), where=scale > 0)
            worst = max(worst, float(off.max(initial=0.0)))
            turn = off > tolerance
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            t = np.where(turn, np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.hypot(1.0, t)
            s = c * t
            g[:, p], g[:, q] = c * a - s * b, s * a + c * b
        if worst <= tolerance:
            return g
    raise ArithmeticError(f"columns are not orthogonal after {max_sweeps} sweeps")


def components(v: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, components as columns) of a covariance, ``most`` at
    most, those of variance only. A component's largest entry is positive."""
    factor, order = pivoted_cholesky(v)
    turned = one_sided_jacobi(factor)
    norms = np.sqrt((turned * turned).sum(axis=0))
    by = np.argsort(-norms, kind="stable")[:most]
    by = by[norms[by] > 0]
    units = np.zeros((len(v), len(by)))
    units[order] = turned[:, by] / norms[by]
    for k in range(len(by)):
        units[:, k] *= math.copysign(1.0, units[np.argmax(np.abs(units[:, k])), k])
    return norms[by] ** 2, units


def _deviations(y: np.ndarray, n: int, rest: list[int]) -> list[int]:
    """Sum over dimensions of (n y - rest)^2, exact, of each row."""
    most = n * int(np.abs(y).max(initial=0)) + max(map(abs, rest))
    if most * most * y.shape[1] < 1 << 63:
        d = n * y - np.array(rest, np.int64)
        return (d * d).sum(axis=1).tolist()
    square, product = (y.astype(object) ** 2).sum(axis=1), y.astype(object) @ np.array(rest, object)
    last = sum(r * r for r in rest)
    return [n * n * int(a) - 2 * n * int(b) + last for a, b in zip(square, product)]


def whiten(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
           most: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation decimal(38,0), whitened, explained,
    identity_error): a row for each remaining vector and component."""
    spark = embeddings.sparkSession
    schema = "vec_id long, deviation decimal(38,0), whitened array<double>"
    columns = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    vectors = embeddings.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"),
                                F.col(f"`{vector_col}`").cast("array<double>").alias("vector"))
    bad = F.exists("vector", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    lengths = vectors.where(F.col("vector").isNotNull() & ~bad).groupBy(F.size("vector").alias("dims")).count().where("dims > 0")
    usual = lengths.orderBy(F.col("count").desc(), F.col("dims").desc()).first()
    nothing = spark.createDataFrame([], "vec_id long, component int, n long, deviation decimal(38,0), whitened double, "
                                        "explained double, identity_error double")
    if usual is None:
        return nothing
    dims = usual["dims"]
    n, totals = sums(vectors, dims)
    v = covariance(vectors, n, totals)
    values, units = components(v, most)
    if not len(values):
        return nothing
    means = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = [s - n * int(m) for s, m in zip(totals, means)]
    by_deviation = units / np.sqrt(values)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, x in _matrices(batches, dims):
            y = x - means
            w = (y - np.array([r / n for r in rest])) @ by_deviation
            rows = pa.array([Decimal(d) if d < 10 ** 38 else None for d in _deviations(y, n, rest)], pa.decimal128(38, 0))
            lists = pa.ListArray.from_arrays(np.arange(0, w.size + 1, w.shape[1], dtype=np.int32), pa.array(w.ravel()))
            yield pa.RecordBatch.from_arrays([ids, rows, lists], ["vec_id", "deviation", "whitened"])

    rows = written(vectors.mapInArrow(project, schema), "whitened")
    k = len(values)
    average = rows.agg(*[F.avg(F.col("whitened")[i]).alias(f"m{i}") for i in range(k)]).first()
    left = [F.col("whitened")[i] - F.lit(average[i]) for i in range(k)]
    measured = rows.agg(*[(F.sum(left[i] * left[j]) / F.lit(n)).alias(f"c{i}_{j}") for i in range(k) for j in range(i + 1)]).first()
    error = max(abs(measured[f"c{i}_{j}"] - (i == j)) for i in range(k) for j in range(i + 1))
    trace = float(np.trace(v))
    shares = F.array(*[F.lit(float(e / trace)) for e in values])
    out = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return out.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(n).cast("long").alias("n"), "deviation", "whitened",
                      F.element_at(shares, F.col("at") + 1).alias("explained"),
                      F.lit(float(error)).alias("identity_error")).select(*columns)
