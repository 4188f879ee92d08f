"""Whitening of embeddings by contour integration of the covariance's resolvent (operator 12).

The covariance of the different fixed-point vectors is summed in tasks and added up row by row. Its
largest eigenvalues are then found as FEAST does:

1. a tridiagonal form of the covariance counts, by the signs of its pivots (its inertia), how many eigenvalues lie
   above any value. Counting places the ends of intervals into gaps, each with a known number of
   eigenvalues;
2. a random block of vectors is projected onto the eigenspace of an interval: the resolvent (zI - V)^-1 Y is
   integrated along a circle through its ends by Gauss-Legendre quadrature. Each node of the circle is
   a task that solves one complex shifted system;
3. Rayleigh-Ritz in the projected space gives eigenvalues and vectors. These are the next block, until
   all residuals are at rounding level and as many eigenvalues lie in the interval as inertia counts.

The matrices have the size of the vectors' dimension, whatever the number of rows. A last pass projects every
row, and one over the fit list measures how far the whitened covariance is from the identity.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, forget, scratch, stored
from .embedding_dedup import _get, _put

#: Fixed-point steps of a unit.
SCALE = 256
#: Entries of a larger size, in fixed point, raise: their exact sums of squares wouldn't fit.
LARGEST = 1 << 40
#: Nodes on the upper half of the circle; eigenvalues that an interval is to hold.
NODES, WIDTH = 8, 8
#: A residual, in parts of the largest eigenvalue, of a component that is found; rounds until then at most.
RESIDUAL, ROUNDS = 1e-13, 40
#: Eigenvalues below this part of the trace are rounding, and no components.
RANK = 1e-13

SCHEMA = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def fixed(vectors: DataFrame) -> DataFrame:
    """(vec_id, x): vectors (vec_id, embedding, ...) in fixed point, each entry floor(256 * c) as long.

    Vectors that are null or hold null or non-finite entries are left out, and so are those of another length than
    most vectors have (the smallest such length, on a tie).
    """
    v = F.col("embedding")
    bad = F.exists(v, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = vectors.select("vec_id", "embedding").where(v.isNotNull() & ~bad)
    lengths = rows.groupBy(F.size(v).alias("k")).count().orderBy(F.desc("count"), "k").first()  # a row for each length
    scaled = F.transform(v, lambda c: F.when(F.abs(c.cast("double") * SCALE) < LARGEST, F.floor(c.cast("double") * SCALE)).otherwise(F.raise_error(F.lit("an entry is too large for fixed point")).cast("long")))
    return rows.where(F.size(v) == (lengths.k if lengths else 0)).select("vec_id", scaled.alias("x"))


def _matrices(batches: Iterator[pa.RecordBatch], column: str = "x") -> Iterator[np.ndarray]:
    for b in batches:
        if b.num_rows:
            x = b.column(column).flatten().to_numpy(zero_copy_only=False)
            yield x.reshape(b.num_rows, -1)


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n, total = 0, None
    for x in _matrices(batches):
        n, total = n + len(x), x.sum(0) if total is None else total + x.sum(0)
    if n:
        values = np.append(total, n)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)], ["i", "v"])


def _rows(m: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.arange(len(m), dtype=np.int32)), pa.array(list(m), pa.list_(pa.float64()))], ["i", "row"])


def _products(mean: np.ndarray) -> Callable:
    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for x in _matrices(batches):
            y = x - mean
            total = y.T @ y if total is None else total + y.T @ y
        if total is not None:
            yield _rows(total)

    return products


def _added(table: pa.Table) -> pa.Table:
    """The sum of the rows of one index, of which each task has made one."""
    column = table.column("row").combine_chunks()
    total = column.flatten().to_numpy().reshape(len(column), -1).sum(0)
    return pa.table({"i": table.column("i")[:1], "row": pa.array([total], pa.list_(pa.float64()))})


def covariance(fit: DataFrame) -> tuple[int, list[int], str]:
    """n, the sums of each dimension, and a folder with the covariance (divisor n) of the vectors x of ``fit``.

    A task makes one matrix of its rows; the matrices are added up row by row by as many tasks as there are rows.
    """
    sums = fit.mapInArrow(_sums, "i int, v long").groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").collect()  # a row for each dimension
    *total, n = [r.v for r in sums] or [0]
    if not n:
        return 0, [], ""
    mean = np.array([s / n for s in total])
    rows = stored(fit.mapInArrow(_products(mean), "i int, row array<double>").groupBy("i").applyInArrow(_added, "i int, row array<double>"), "products")
    folder = scratch(fit.sparkSession, "covariance")

    def write(table: pa.Table) -> pa.Table:
        table = table.sort_by("i")
        v = table.column("row").combine_chunks().flatten().to_numpy().reshape(table.num_rows, -1) / n
        v = (v + v.T) / 2
        _put(folder)("v", v)
        diagonal, beside = tridiagonal(v)
        return pa.table({"diagonal": pa.array([diagonal], pa.list_(pa.float64())), "beside": pa.array([beside], pa.list_(pa.float64())), "trace": [float(np.trace(v))]})

    form = rows.withColumn("all", F.lit(0)).groupBy("all").applyInArrow(write, "diagonal array<double>, beside array<double>, trace double")
    stored(form, "form").write.mode("overwrite").parquet(f"{folder}/form")
    forget(rows)
    return n, total, folder


def tridiagonal(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and subdiagonal of a tridiagonal matrix that is orthogonally similar to the symmetric ``v``."""
    a = v.copy()
    for k in range(len(a) - 2):
        x = a[k + 1 :, k].copy()
        size = np.linalg.norm(x)
        x[0] += np.copysign(size, x[0])
        if (length := np.linalg.norm(x)) == 0:
            continue
        x /= length
        rest = a[k + 1 :, k + 1 :]
        p = rest @ x
        w = p - (x @ p) * x
        rest -= 2 * (np.outer(x, w) + np.outer(w, x))
        a[k + 1, k] = -np.copysign(size, a[k + 1, k])
    return np.diag(a).copy(), np.diag(a, -1).copy()


def above(form: tuple[np.ndarray, np.ndarray], values: np.ndarray) -> np.ndarray:
    """How many eigenvalues of the tridiagonal ``form`` are above each value: the positive pivots of its
    LDL' factors after the value is subtracted."""
    diagonal, beside = form
    squares = np.append(0.0, beside * beside)
    tiny = np.finfo(float).tiny
    pivot, count = np.ones(len(values)), np.zeros(len(values), np.int64)
    for d, s in zip(diagonal, squares):
        pivot = d - values - s / pivot
        pivot[pivot == 0] = -tiny
        count += pivot > 0
    return count


def _kth(form, k: int, low: float, high: float) -> float:
    """The k-th largest eigenvalue, to a few units of rounding."""
    for _ in range(12):
        cuts = np.linspace(low, high, 66)
        counts = above(form, cuts[1:-1])
        at = int((counts >= k).sum())
        low, high = cuts[at], cuts[at + 1]
    return (low + high) / 2


def intervals(form, k: int, trace: float) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues in it) from the top that hold the k largest eigenvalues, with about
    ``WIDTH`` in each and their ends within gaps, and fewer than k where the rest is rounding. A cluster
    of equal eigenvalues is never parted."""
    diagonal, beside = form
    size = len(diagonal)
    reach = np.abs(np.append(beside, 0.0)) + np.abs(np.append(0.0, beside))
    top = float((diagonal + reach).max())
    if not trace > 0:
        return []
    top *= 1 + 1e-3
    rank = int(above(form, np.array([RANK * trace]))[0])
    out, done, high = [], 0, top
    while done < min(k, rank):
        m = min(done + WIDTH, min(k, rank))
        upper = _kth(form, m, 0.0, top)
        while True:  # until there is a gap below the m-th
            lower = _kth(form, m + 1, -RANK * trace, top) if m < size else 0.0
            if m == size or upper - lower > 1e-9 * trace or m >= rank:
                break
            m, upper = m + 1, lower
        low = max((upper + lower) / 2, upper / 2) if m < rank else max(upper / 2, lower)
        out.append((float(low), float(high), m - done))
        done, high = m, low
    return out


def _solve(folder: str) -> Callable:
    """Rows (interval, node, center, radius, block) as (interval, part): the node's share of the projected block."""
    x, weight = np.polynomial.legendre.leggauss(NODES)

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = None
        for b in batches:
            for r in b.to_pylist():
                v = np.array(_get(folder)("v")) if v is None else v
                y = np.frombuffer(r["block"]).reshape(len(v), -1)
                turn = np.exp(1j * np.pi / 2 * (1 - x[r["node"]]))
                shifted = -v.astype(complex)
                shifted[np.diag_indices(len(v))] += r["center"] + r["radius"] * turn
                part = (weight[r["node"]] / 2 * r["radius"] * turn * np.linalg.solve(shifted, y)).real
                yield pa.RecordBatch.from_arrays([pa.array([r["interval"]], pa.int32()), pa.array([part.tobytes()])], ["interval", "part"])

    return solve


def _ritz(folder: str) -> Callable:
    def ritz(table: pa.Table) -> pa.Table:
        v = np.array(_get(folder)("v"))
        q = sum(np.frombuffer(p).reshape(len(v), -1) for p in table.column("part").to_pylist())
        left, size, _ = np.linalg.svd(q, full_matrices=False)
        q = left[:, size > size[0] * 1e-14]
        values, turn = np.linalg.eigh(q.T @ v @ q)
        vectors = q @ turn
        residuals = np.linalg.norm(v @ vectors - vectors * values, axis=0)
        doubles = pa.list_(pa.float64())
        return pa.table({"interval": table.column("interval")[:1], "values": pa.array([values], doubles), "residuals": pa.array([residuals], doubles), "block": pa.array([np.ascontiguousarray(vectors).tobytes()])})

    return ritz


def components(spark: SparkSession, folder: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """The k largest eigenvalues of the covariance in ``folder``, their unit eigenvectors as rows, and the trace.

    Fewer come back where the covariance has no more that are above rounding. Of each vector, the first of its
    entries that are largest in size is positive. An interval that doesn't reach the count that inertia gives raises.
    """
    form = spark.read.parquet(f"{folder}/form").first()
    trace, form = form.trace, (np.array(form.diagonal), np.array(form.beside))
    size = len(form[0])
    open_ = dict(enumerate(intervals(form, k, trace)))
    if not open_:
        return np.zeros(0), np.zeros((0, size)), trace
    limit = RESIDUAL * open_[0][1]
    blocks = {i: np.random.default_rng(i).standard_normal((size, min(size, 2 * m + 4))) for i, (_, _, m) in open_.items()}
    found: list[tuple[float, np.ndarray]] = []
    for _ in range(ROUNDS):
        rows = [(i, j, (low + high) / 2, (high - low) / 2, np.ascontiguousarray(blocks[i]).tobytes()) for i, (low, high, _) in open_.items() for j in range(NODES)]
        asked = spark.createDataFrame(rows, "interval int, node int, center double, radius double, block binary").repartition(len(rows), "interval", "node")
        parts = asked.mapInArrow(_solve(folder), "interval int, part binary")
        for r in parts.groupBy("interval").applyInArrow(_ritz(folder), "interval int, values array<double>, residuals array<double>, block binary").collect():
            low, high, m = open_[r.interval]
            values, vectors = np.array(r["values"]), np.frombuffer(r.block).reshape(size, -1)
            inside = (values > low) & (values < high)
            if inside.sum() == m and (np.array(r.residuals)[inside] <= limit).all():
                found += [(values[c], vectors[:, c]) for c in np.flatnonzero(inside)]
                del open_[r.interval]
            else:
                blocks[r.interval] = vectors if vectors.shape[1] >= min(size, m + 1) else np.random.default_rng(size).standard_normal((size, min(size, 4 * m + 4)))
        if not open_:
            break
    else:
        raise ArithmeticError(f"no convergence in {list(open_.values())}")
    found = sorted(found, key=lambda x: -x[0])[:k]
    vectors = np.array([x / np.linalg.norm(x) for _, x in found])
    at = np.abs(vectors).argmax(1)
    return np.array([e for e, _ in found]), vectors * np.sign(vectors[np.arange(len(found)), at])[:, None], trace


def _deviation(x: np.ndarray, n: int, total: list[int]) -> np.ndarray:
    """Sums over the dimensions of (n * x - S)^2, exact; one that is no long raises."""
    most = n * max(int(np.abs(x).max(initial=0)), 1) + max(map(abs, total), default=0)
    if most * most * x.shape[1] < 1 << 63:
        d = n * x - np.array(total, np.int64)
        return (d * d).sum(1)
    d = n * x.astype(object) - np.array(total, object)
    return np.array([int(v) for v in (d * d).sum(1)], np.int64)


def _projected(n: int, total: list[int], axes: np.ndarray, shares: np.ndarray, error: float) -> Callable:
    mean, k = np.array([s / n for s in total]), len(axes)

    def projected(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for x in _matrices([b]):
                ids = b.column("vec_id").take(pa.array(np.repeat(np.arange(len(x)), k)))
                arrays = [
                    ids, pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))), pa.array(np.full(len(x) * k, n)), pa.array(np.repeat(_deviation(x, n, total), k)),
                    pa.array(((x - mean) @ axes.T).ravel()), pa.array(np.tile(shares, len(x))), pa.array(np.full(len(x) * k, error)),
                ]
                yield pa.RecordBatch.from_arrays(arrays, ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return projected


def _moments(mean: np.ndarray, axes: np.ndarray) -> Callable:
    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, center, spread = 0, np.zeros(len(axes)), np.zeros((len(axes), len(axes)))
        for x in _matrices(batches):
            w = (x - mean) @ axes.T
            own = w.mean(0)
            spread += (w - own).T @ (w - own) + np.outer(own - center, own - center) * n * len(w) / (n + len(w))
            center, n = center + (own - center) * len(w) / (n + len(w)), n + len(w)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([center], pa.list_(pa.float64())), pa.array([spread.ravel()], pa.list_(pa.float64()))], ["n", "center", "spread"])

    return moments


def _identity_error(fit: DataFrame, mean: np.ndarray, axes: np.ndarray) -> float:
    """The largest entry of the whitened covariance less the identity; a task returns one small matrix."""
    n, center, spread = 0, np.zeros(len(axes)), np.zeros((len(axes), len(axes)))
    for r in fit.mapInArrow(_moments(mean, axes), "n long, center array<double>, spread array<double>").toLocalIterator():
        own = np.array(r.center) - center
        spread += np.array(r.spread).reshape(spread.shape) + np.outer(own, own) * (n * r.n / (n + r.n))
        center, n = center + own * r.n / (n + r.n), n + r.n
    return float(np.abs(spread / n - np.eye(len(axes))).max())


def whitened(vectors: DataFrame, *, k: int = 4) -> DataFrame:
    """Each usable vector of ``vectors`` (vec_id, embedding, ...; see ``fixed``) on the k first components of the
    covariance of all different ones: vec_id, component (from 1), n (different vectors), deviation
    (sum of (n * x - S)^2, exact), whitened (x less the mean on the component, over the root of its
    eigenvalue), explained (the eigenvalue's part of the trace) and identity_error (of the whole).

    Repeated vectors count once in the fit and have a row for each component all the same, and so have rows that share a vec_id or
    have none. There are fewer than k components where the covariance has fewer eigenvalues above
    rounding, and no rows where it has none (an empty table, or all vectors equal). Components of equal
    eigenvalues are some orthonormal ones of their space.
    """
    spark = vectors.sparkSession
    rows = stored(fixed(vectors), "fixed")
    fit = stored(rows.select("x").distinct(), "fit")
    kind = vectors.schema["vec_id"].dataType.simpleString()
    n, total, folder = covariance(fit)
    values, axes, trace = components(spark, folder, k) if n else (np.zeros(0), np.zeros((0, 0)), 0.0)
    if not len(values):
        return spark.createDataFrame([], f"vec_id {kind}, {SCHEMA}")
    scaled = axes / np.sqrt(values)[:, None]
    error = _identity_error(fit, np.array([s / n for s in total]), scaled)
    discard(spark, folder)
    forget(fit)
    return rows.mapInArrow(_projected(n, total, scaled, values / trace, error), f"vec_id {kind}, {SCHEMA}")
