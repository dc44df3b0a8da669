"""Whitening of embeddings by pivoted Cholesky and one-sided Jacobi on the triangular factor.

Entries become whole numbers ``floor(1024 c) + 100000``. Tasks add up exact sums, then the scatter
of the vectors less the whole part of their mean; the rest of the mean is taken off exactly. The
centred scatter is factored as ``L L'`` with the largest pivot first, which shows its rank. Plane
rotations from the right make the columns of ``L`` orthogonal: their squared norms are then the
eigenvalues, and the normalised columns are the components. The scatter is never diagonalised.

What leaves the tasks is one number per pair of dimensions, however many vectors there are.

Defined cases: a row whose vector is null or holds a null, NaN or infinite entry is dropped, and so
is one whose length isn't the most frequent one (the largest of several). Products ``1024 c`` beyond
``LARGEST`` count as that. Repeated rows and ids count each for itself; a null id
stays null. Components of no variance don't exist, so equal vectors, one vector, or a table without
usable rows give no rows. A deviation beyond 64 bits is null. Other columns are left alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import kernel

SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
ROWS = 4096
LARGEST = 2.0**61
WHITENED = (
    "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, "
    "identity_error double"
)


def usable(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and whole-number vectors of the usable rows, in runs of one length."""
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    entries = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    held = np.maximum(lengths, 0)
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(entries))])
    begins = np.cumsum(held) - held
    fine = (lengths >= 0) & (bad[begins + held] == bad[begins])
    for length in np.unique(lengths[fine]).tolist():
        places = np.flatnonzero(fine & (lengths == length))
        for at in range(0, len(places), ROWS):
            some = places[at : at + ROWS]
            vectors = np.floor(SCALE * entries[begins[some, None] + np.arange(length)])
            yield some, np.clip(vectors, -LARGEST, LARGEST).astype(np.int64) + SHIFT


def sums(rows: DataFrame) -> tuple[int, list[int]]:
    """Number of usable vectors of the most frequent length, and their exact sums by dimension."""

    def run(batches):
        totals: dict[int, tuple[int, list]] = {}
        for b in batches:
            for some, x in usable(b.column(0)):
                # Halves of 32 bits add up without overflow.
                high, low = (x >> 32).sum(0).tolist(), (x & 0xFFFFFFFF).sum(0).tolist()
                n, old = totals.get(x.shape[1], (0, [0] * x.shape[1]))
                totals[x.shape[1]] = n + len(some), [o + (h << 32) + k for o, h, k in zip(old, high, low)]
        out = [(size, place, Decimal(t)) for size, (n, s) in totals.items() for place, t in enumerate([n, *s])]
        sizes, places, values = zip(*out) if out else ((), (), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(sizes, pa.int32()), pa.array(places, pa.int32()), pa.array(values, pa.decimal128(38, 0))],
            ["size", "place", "total"],
        )

    parts = kernel(rows.select("embedding"), run, "size int, place int, total decimal(38,0)")
    totals = parts.groupBy("size", "place").agg(F.sum("total").alias("total"))
    found = keep_most(totals)
    return (int(found[0]), [int(t) for t in found[1:]]) if found else (0, [])


def keep_most(totals: DataFrame) -> list[Decimal]:
    """The totals of the length with most vectors; few rows, one per length and place."""
    most = totals.filter("place = 0").orderBy(F.desc("total"), F.desc("size")).limit(1).select("size").collect()
    if not most:
        return []
    return [r.total for r in totals.filter(F.col("size") == most[0].size).orderBy("place").collect()]


def scatter(rows: DataFrame, middle: np.ndarray) -> np.ndarray:
    """Sum over the vectors of the outer product of ``x - middle`` with itself."""
    d = len(middle)
    upper = np.triu_indices(d)

    def run(batches):
        total = np.zeros((d, d))
        for b in batches:
            for _, x in usable(b.column(0)):
                if x.shape[1] == d:
                    y = (x - middle).astype(np.float64)
                    total += y.T @ y
        yield pa.RecordBatch.from_arrays(
            [pa.array(upper[0], pa.int32()), pa.array(upper[1], pa.int32()), pa.array(total[upper])], ["i", "j", "v"]
        )

    parts = kernel(rows.select("embedding"), run, "i int, j int, v double")
    out = np.zeros((d, d))
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        out[i, j] = out[j, i] = v
    return out


def pivoted_cholesky(matrix: np.ndarray) -> np.ndarray:
    """``L`` with ``L L' = matrix``, rows in the matrix's order, as many columns as its rank."""
    a, d = matrix.copy(), len(matrix)
    order, out = np.arange(d), np.zeros((d, d))
    least = d * np.finfo(float).eps * max(a.diagonal().max(initial=0.0), 0.0)
    rank = 0
    while rank < d:
        pivot = rank + int(np.argmax(a.diagonal()[rank:]))
        if not a[pivot, pivot] > least:
            break
        for m in (a, a.T, order, out):
            m[[rank, pivot]] = m[[pivot, rank]]
        column = a[rank:, rank] / np.sqrt(a[rank, rank])
        out[rank:, rank] = column
        a[rank:, rank:] -= np.outer(column, column)
        rank += 1
    back = np.empty_like(out)
    back[order] = out
    return back[:, :rank]


def jacobi(factor: np.ndarray, sweeps: int = 60) -> tuple[np.ndarray, np.ndarray]:
    """Squared norms and directions of the factor's columns once rotations have made them orthogonal.

    Columns are paired as in a round-robin tournament, so the rotations of a round don't meet.
    """
    rank = factor.shape[1]
    odd = rank % 2
    u = np.concatenate([factor, np.zeros((len(factor), odd))], 1)
    n = rank + odd
    seats = np.arange(n)
    for _ in range(sweeps if n > 1 else 0):
        largest = 0.0
        for _ in range(n - 1):
            left, right = seats[: n // 2], seats[: n // 2 - 1 : -1]
            a, b = u[:, left], u[:, right]
            aa, bb, ab = (a * a).sum(0), (b * b).sum(0), (a * b).sum(0)
            size = np.sqrt(aa * bb)
            angle = np.divide(np.abs(ab), size, out=np.zeros_like(ab), where=size > 0)
            largest = max(largest, angle.max())
            turn = np.flatnonzero(angle > np.finfo(float).eps)
            zeta = (bb[turn] - aa[turn]) / (2 * ab[turn])
            t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
            c = 1 / np.hypot(1, t)
            u[:, left[turn]], u[:, right[turn]] = c * (a[:, turn] - t * b[:, turn]), c * (t * a[:, turn] + b[:, turn])
            seats[1:] = np.roll(seats[1:], 1)
        if largest <= 4 * np.finfo(float).eps:
            break
    norms = np.sqrt((u * u).sum(0))
    first = np.argsort(-norms, kind="stable")[:rank]
    return norms[first] ** 2, u[:, first] / norms[first]


class Model:
    """Mean and leading components of the usable vectors."""

    def __init__(self, n: int, totals: list[int], middle: np.ndarray, rest: np.ndarray, covariance: np.ndarray):
        self.n, self.totals, self.middle, self.rest = n, totals, middle, rest
        values, vectors = jacobi(pivoted_cholesky(covariance))
        self.values, self.vectors = values[:COMPONENTS], vectors[:, :COMPONENTS]
        self.explained = self.values / max(covariance.trace(), np.finfo(float).tiny)

    def whiten(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.middle).astype(np.float64) - self.rest / self.n) @ self.vectors / np.sqrt(self.values)

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Exact sums over the dimensions of ``(n x - S)^2``."""
        most = max(int(x.max(initial=0)), -int(x.min(initial=0)), *map(abs, self.middle.tolist()), 1)
        if x.shape[1] * (2 * self.n * most) ** 2 < 2**63:
            y = self.n * x - np.array(self.totals, np.int64)
            return (y * y).sum(1).tolist()
        y = self.n * (x - self.middle) if self.n * 2 * most < 2**62 else self.n * (x.astype(object) - self.middle)
        y = y - self.rest.astype(np.int64 if y.dtype != object else object)
        largest = int(np.abs(y).max(initial=0))
        if x.shape[1] * largest**2 < 2**63:
            return (y * y).sum(1).tolist()
        exact = [sum(v * v for v in row) for row in y.tolist()]
        return [v if v < 2**63 else None for v in exact]


def fit(rows: DataFrame) -> Model | None:
    """Model of all usable ``embedding`` vectors; None where there is none or all are equal."""
    n, totals = sums(rows)
    if not n or not totals:
        return None
    middle = np.array([(2 * s + n) // (2 * n) for s in totals], np.int64)
    rest = np.array([s - n * m for s, m in zip(totals, middle.tolist())], np.float64)
    model = Model(n, totals, middle, rest, (scatter(rows, middle) - np.outer(rest, rest) / n) / n)
    return model if len(model.values) else None


def identity_error(rows: DataFrame, model: Model) -> float:
    """Largest entry of the whitened vectors' covariance less the identity."""
    d, k = model.vectors.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        total = np.zeros((k, k + 1))
        for b in batches:
            for _, x in usable(b.column(0)):
                if x.shape[1] == d:
                    w = shared.value.whiten(x)
                    total += w.T @ np.concatenate([w, np.ones((len(w), 1))], 1)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays(
            [pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], ["i", "j", "v"]
        )

    total = np.zeros((k, k + 1))
    parts = kernel(rows.select("embedding"), run, "i int, j int, v double")
    for i, j, v in parts.groupBy("i", "j").agg(F.sum("v")).collect():
        total[i, j] = v / model.n
    mean = total[:, k]
    return float(np.abs(total[:, :k] - np.outer(mean, mean) - np.eye(k)).max())


def whiten(rows: DataFrame) -> DataFrame:
    """``vec_id, embedding`` -> a row per usable vector and component."""
    model = fit(rows)
    if model is None:
        return rows.sparkSession.createDataFrame([], WHITENED)
    error, (d, k) = identity_error(rows, model), model.vectors.shape
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        for b in batches:
            for some, x in usable(b.column(1)):
                if x.shape[1] != d:
                    continue
                n = len(some) * k
                whitened = model.whiten(x)
                yield pa.RecordBatch.from_arrays(
                    [
                        b.column(0).take(pa.array(np.repeat(some, k))),
                        pa.array(np.tile(np.arange(1, k + 1), len(some)), pa.int32()),
                        pa.array(np.full(n, model.n), pa.int64()),
                        pa.array([v for v in model.deviations(x) for _ in range(k)], pa.int64()),
                        pa.array(whitened.ravel()),
                        pa.array(np.tile(model.explained, len(some))),
                        pa.array(np.full(n, error)),
                    ],
                    WHITENED_NAMES,
                )

    return kernel(rows.select(F.col("vec_id").cast("bigint"), "embedding"), run, WHITENED)


WHITENED_NAMES = [c.split()[0] for c in WHITENED.split(", ")]
