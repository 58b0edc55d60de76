"""Whitening of embeddings by their principal components.

The centred scatter matrix is summed on Spark. Its Cholesky factor with diagonal pivoting, taken to the numerical rank,
is a lower triangular matrix whose columns a one-sided Jacobi method rotates until they are orthogonal: the rotated
columns' squared norms are the eigenvalues, the normalised columns the eigenvectors. Small eigenvalues keep their
relative precision, because the matrix is never squared again and the pivots come in falling order.

Vectors are read three times (sums; scatter and deviations; covariance of the result), each time in batches. A task
sends one row per matrix row, made of its own means and centred products, and parts are merged pairwise with the
correction for their means; what reaches the driver has the size of the matrix, whatever the number of vectors.

Entries are scaled to whole numbers, floor(SCALE * c) + SHIFT, so that sums and deviations are exact.

Defined results: rows whose vector is null or holds a null or non-finite entry are left out; so are vectors whose
length is not the most frequent one (of equally frequent ones the greatest). Directions without any spread are no
components, so a table of equal vectors, of empty vectors or without rows gives no rows. Equal eigenvalues: any
orthonormal basis of their space, the same for all rows. Repeated rows count as often as they stand there. A deviation
beyond 64 bits is null. Entries beyond 2^50 are taken as 2^50. Columns beside vec_id and embedding are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SCALE, SHIFT = 1024, 100_000
LARGEST = 2.0**60
COMPONENTS = 8
SWEEPS = 60
TOLERANCE = 1e-15
PART = 4096  # vectors multiplied at once


# --- matrices ---------------------------------------------------------------------------------------


def pivoted_cholesky(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(L, order) with a[order][:, order] = L @ L.T, as many columns as the numerical rank."""
    a = a.copy()
    n = len(a)
    order = np.arange(n)
    out = np.zeros((n, n))
    first = a.diagonal().max(initial=0.0)
    for k in range(n):
        p = k + int(np.argmax(a.diagonal()[k:]))
        if not a[p, p] > n * np.finfo(float).eps * first:
            return out[:, :k], order
        for m in (a, a.T):
            m[[k, p]] = m[[p, k]]
        out[[k, p]] = out[[p, k]]
        order[[k, p]] = order[[p, k]]
        out[k:, k] = a[k:, k] / np.sqrt(a[k, k])
        a[k + 1 :, k + 1 :] -= np.outer(out[k + 1 :, k], out[k + 1 :, k])
    return out, order


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs of n columns (n even) in n - 1 rounds of disjoint pairs."""
    ring = list(range(1, n))
    for _ in range(n - 1):
        line = [0, *ring]
        yield np.array(line[: n // 2]), np.array(line[: n // 2 - 1 : -1])
        ring = ring[-1:] + ring[:-1]


def one_sided_jacobi(columns: np.ndarray) -> np.ndarray:
    """``columns`` after rotations that make them orthogonal, by falling norm."""
    g = columns.copy()
    if g.shape[1] % 2:
        g = np.hstack([g, np.zeros((len(g), 1))])
    for _ in range(SWEEPS):
        worst = 0.0
        for p, q in _rounds(g.shape[1]) if g.shape[1] else ():
            x, y = g[:, p], g[:, q]
            xx, yy, xy = (x * x).sum(0), (y * y).sum(0), (x * y).sum(0)
            size = np.sqrt(xx * yy)
            turn = np.abs(xy) > TOLERANCE * size
            worst = max(worst, float((np.abs(xy[turn]) / size[turn]).max(initial=0.0)))
            zeta = (yy[turn] - xx[turn]) / (2 * xy[turn])
            t = np.where(zeta >= 0, 1.0, -1.0) / (np.abs(zeta) + np.hypot(1.0, zeta))
            c, s = np.ones(len(p)), np.zeros(len(p))
            c[turn] = 1 / np.hypot(1.0, t)
            s[turn] = c[turn] * t
            g[:, p], g[:, q] = c * x - s * y, s * x + c * y
        if worst < len(g) * TOLERANCE:
            break
    norms = np.sqrt((g * g).sum(0))
    return g[:, np.argsort(-norms, kind="stable")][:, : columns.shape[1]]


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(values, vectors as columns) of a positive semidefinite matrix, falling, without those of value 0."""
    factor, order = pivoted_cholesky(a)
    turned = one_sided_jacobi(factor)
    values = (turned * turned).sum(0)
    vectors = np.empty_like(turned)
    vectors[order] = turned / np.sqrt(values)
    return values, vectors


# --- tables -----------------------------------------------------------------------------------------


def _matrix(column: pa.Array, dims: int) -> np.ndarray:
    flat = column.flatten()
    return flat.to_numpy(zero_copy_only=False).reshape(len(column), dims)


def _whole(column: pa.Array, dims: int) -> np.ndarray:
    return np.clip(np.floor(SCALE * _matrix(column, dims).astype(float)), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _total(x: np.ndarray) -> np.ndarray:
    """Exact sums over the vectors."""
    fits = max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) * len(x) < 1 << 62
    return x.sum(0) if fits else x.astype(object).sum(0)


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """vec_id, embedding without the rows that are left out, and the length of the vectors."""
    finite = F.forall("embedding", lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    rows = vectors.select("vec_id", "embedding").where(F.col("embedding").isNotNull() & finite)
    sizes = rows.groupBy(F.size("embedding").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    first = sizes.orderBy(F.col("n").desc(), F.col("d").desc()).first()
    dims = first["d"] if first else 0
    return rows.where(F.size("embedding") == dims), dims


def _sums(vectors: DataFrame, dims: int) -> tuple[int, list[int]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = 0, np.zeros(dims, object)
        for b in batches:
            x = _whole(b.column(0), dims)
            n, total = n + len(x), total + _total(x)
        if n:
            yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array(total.tolist(), pa.decimal128(38, 0))], names=["i", "n", "s"])

    parts = vectors.select("embedding").mapInArrow(run, "i int, n long, s decimal(38,0)")
    rows = parts.groupBy("i").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).collect()
    by_dim = {r["i"]: r for r in rows}
    return (by_dim[0]["n"], [int(by_dim[i]["s"]) for i in range(dims)]) if rows else (0, [0] * dims)


def _merged(parts: Iterator[tuple[float, np.ndarray, np.ndarray]], dims: int) -> tuple[float, np.ndarray, np.ndarray]:
    """(n, mean, centred products) of the union of parts."""
    n, mean, products = 0.0, np.zeros(dims), np.zeros((dims, dims))
    for m, other, more in parts:
        gap, both = other - mean, n + m
        products = products + more + np.outer(gap, gap) * (n * m / both)
        mean, n = mean + gap * (m / both), both
    return n, mean, products


def _own(parts: Iterator[np.ndarray], dims: int) -> tuple[float, np.ndarray, np.ndarray]:
    def one(x: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        mean = x.mean(0)
        return float(len(x)), mean, (x - mean).T @ (x - mean)

    return _merged((one(x[i : i + PART]) for x in parts for i in range(0, len(x), PART)), dims)


def scatter(rows: DataFrame, dims: int, values) -> np.ndarray:
    """Covariance, divisor n, of ``values(batch)``; every part is centred before multiplying.

    A task's products are relative to its own mean; n * mean and the mean's products travel as sums, so merging parts
    is a grouped sum per matrix row: products + n * mean mean' - (total mean)(total mean)' n. The means are those of
    values near 0, which the caller sees to, so the correction loses no digits.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, mean, products = _own((values(b) for b in batches if b.num_rows), dims)
        if n:
            full = products + n * np.outer(mean, mean)
            yield pa.record_batch([pa.array(range(dims), pa.int32()), pa.array([n] * dims), pa.array(n * mean), pa.array(list(full), pa.list_(pa.float64()))], names=["i", "n", "s", "row"])

    parts = rows.mapInArrow(run, "i int, n double, s double, row array<double>")
    flat = parts.select("i", "n", "s", F.posexplode("row").alias("j", "v"))
    summed = flat.groupBy("i", "j").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("v").alias("v"))
    lines = summed.groupBy("i").agg(F.max("n").alias("n"), F.max("s").alias("s"), F.sort_array(F.collect_list(F.struct("j", "v"))).alias("row")).collect()
    total, sums, out = 0.0, np.zeros(dims), np.zeros((dims, dims))
    for r in lines:
        total, sums[r["i"]] = r["n"], r["s"]
        out[r["i"]] = [x["v"] for x in r["row"]]
    if not total:
        return out
    out = (out + out.T) / 2
    return out / total - np.outer(sums / total, sums / total)


@dataclass(frozen=True)
class Whitening:
    n: int
    sums: list[int]
    values: np.ndarray  # eigenvalues of the covariance, falling
    vectors: np.ndarray  # components as columns
    trace: float


def _centred(column: pa.Array, n: int, sums: list[int]) -> np.ndarray:
    """x - S / n; the whole part of the mean is taken off exactly."""
    whole = np.array([s // n for s in sums], np.int64)
    rest = np.array([s % n / n for s in sums])
    return (_whole(column, len(sums)) - whole) - rest


def fit(vectors: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    n, sums = _sums(vectors, dims)
    if not n:
        return Whitening(0, sums, np.zeros(0), np.zeros((dims, 0)), 0.0)
    cov = scatter(vectors.select("embedding"), dims, lambda b: _centred(b.column(0), n, sums))
    values, vectors_ = eigen(cov)
    return Whitening(n, sums, values[:components], vectors_[:, :components], float(np.trace(cov)))


def _deviations(column: pa.Array, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n x - S)^2, exactly: in 64-bit numbers where they hold it, else in whole Python ones."""
    x, s = _whole(column, len(sums)), np.array(sums, object)
    bound = max((abs(n * int(v) - t) for v, t in zip(x.max(0), sums)), default=0), max((abs(n * int(v) - t) for v, t in zip(x.min(0), sums)), default=0)
    if max(bound) ** 2 * len(sums) < 1 << 63 and max(abs(int(x.max())), abs(int(x.min()))) * n < 1 << 62:
        d = x * n - s.astype(np.int64)
        return (d * d).sum(1).tolist()
    exact = ((x.astype(object) * n - s) ** 2).sum(1).tolist()
    return [v if v < 1 << 63 else None for v in exact]


def whiten(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error."""
    rows, dims = usable(vectors)
    own = rows.schema["vec_id"].dataType.simpleString()
    out = f"vec_id {own}, component int, n long, deviation long, whitened double, explained double"
    model = fit(rows, dims, components) if dims else Whitening(0, [], np.zeros(0), np.zeros((0, 0)), 0.0)
    k = len(model.values)
    if not k:
        return rows.sparkSession.createDataFrame([], out + ", identity_error double")
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def projected(column: pa.Array) -> np.ndarray:
        m = shared.value
        return _centred(column, m.n, m.sums) @ (m.vectors / np.sqrt(m.values))

    cov = scatter(rows.select("embedding"), k, lambda b: projected(b.column(0)))
    error = float(np.abs(cov - np.eye(k)).max())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            ids, column = b.column(0), b.column(1)
            each = np.repeat(np.arange(len(ids)), k)
            deviations = pa.array(_deviations(column, m.n, m.sums), pa.int64())
            yield pa.record_batch(
                [
                    ids.take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(ids))),
                    pa.array(np.full(len(each), m.n, np.int64)),
                    deviations.take(pa.array(each)),
                    pa.array(projected(column).ravel()),
                    pa.array(np.tile(m.values / m.trace, len(ids))),
                ],
                names=["vec_id", "component", "n", "deviation", "whitened", "explained"],
            )

    return rows.mapInArrow(run, out).withColumn("identity_error", F.lit(error))
