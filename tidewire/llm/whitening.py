"""Whitening of embeddings with eigenvectors refined from single to double precision.

Entries become whole numbers, floor(64 c) + 1000000, so counts and sums are exact.  Spark sums them in one pass, and the
products of centred entries in a second one; the driver only sees one matrix, as large as the dimension of the
vectors and not as their number.  Its eigenvectors are found in float32 and corrected in float64 by the matrix
iteration of Ogita and Aishima, which doubles the correct digits each time where eigenvalues are apart.  Columns of
clustered eigenvalues are not told apart by it: each cluster gets a small eigenproblem of its own, on the matrix less
the cluster's mean and scaled, and the iteration goes on with the rotated columns.

Defined results: a row whose vector is null, empty, or holds a null or non-finite entry, or one whose whole number is beyond
2^62, takes no part.  Vectors of unlike lengths are whitened apart, each length with its own fit.  Components without
variance (less than 1e-12 of the largest) cannot be whitened and are left out, so equal vectors give no rows; equal
eigenvalues have any orthonormal basis of their space.  Repeated rows count as often as they occur; an empty
table gives an empty table; other columns take no part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Components returned at most; steps and shift of the whole numbers.
COMPONENTS, SCALE, SHIFT = 32, 64.0, 1_000_000
#: Whole numbers are smaller than this; components with a smaller share of the largest variance have none.
_LARGEST, _NO_VARIANCE = float(1 << 62), 1e-12
#: Corrections at most; each doubles the correct digits, a cluster takes a few more.
_STEPS = 40


class Fit:
    """Exact number and sums of the vectors of one length, and what the passes add: components, their shares, error."""

    def __init__(self, count: int, sums: list[int]) -> None:
        self.count, self.sums = count, sums
        self.axes = np.zeros((len(sums), 0))
        self.values = self.shares = np.zeros(0)
        self.error = 0.0

    def apart(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n x - S exactly, and x - S / n in double precision."""
        bound = max((abs(s) for s in self.sums), default=0) + self.count * int(np.abs(x).max(initial=0))
        if bound < 1 << 62:
            exact = x * self.count - np.array(self.sums, np.int64)
            return exact, exact / self.count
        exact = x.astype(object) * self.count - np.array(self.sums, object)
        return exact, (exact / self.count).astype(np.float64)

    def whiten(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.axes / np.sqrt(self.values)


def whole(batch: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """By length of vectors: rows that take part, and their whole numbers."""
    lists = batch.cast(pa.large_list(pa.float64()))
    entries = lists.flatten().to_numpy(zero_copy_only=False)
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False)
    first = np.cumsum(sizes) - sizes
    for length in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == length)
        values = entries[first[rows][:, None] + np.arange(length)]
        with np.errstate(invalid="ignore", over="ignore"):
            steps = np.floor(values * SCALE)
            usable = (np.isfinite(steps) & (np.abs(steps) < _LARGEST)).all(axis=1)
        if usable.any():
            yield rows[usable], steps[usable].astype(np.int64) + SHIFT


def exact_sums(x: np.ndarray) -> list[int]:
    """Sums of columns as Python integers."""
    if len(x) * int(np.abs(x).max(initial=0)) < 1 << 62:
        return [int(s) for s in x.sum(axis=0)]
    return [int(s) for s in x.astype(object).sum(axis=0)]


def squares(x: np.ndarray) -> list[int]:
    """Exact sum of the squares of each row; numbers below 2^50 in two parts of 25 bits."""
    if x.dtype == object or int(np.abs(x).max(initial=0)) >= 1 << 50 or x.shape[1] > 4096:
        return [sum(int(v) * int(v) for v in row) for row in x]
    high, low = x >> 25, x & ((1 << 25) - 1)
    parts = ((high * high).sum(axis=1), (high * low).sum(axis=1), (low * low).sum(axis=1))
    return [(a << 50) + (b << 26) + c for a, b, c in zip(*(p.tolist() for p in parts), strict=True)]


def _sums(vectors: DataFrame) -> dict[int, Fit]:
    """Number and sums by length, added by Spark as exact decimals."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple[int, list[int]]] = {}
        for batch in batches:
            for _, x in whole(batch.column(1)):
                count, sums = found.get(x.shape[1], (0, [0] * x.shape[1]))
                found[x.shape[1]] = count + len(x), [a + b for a, b in zip(sums, exact_sums(x), strict=True)]
        for length, (count, sums) in found.items():
            yield pa.RecordBatch.from_pydict(
                {"length": [length] * length, "i": range(length), "n": [count] * length, "s": [str(s) for s in sums]}
            )

    parts = vectors.mapInArrow(partial, "length long, i long, n long, s string")
    total = parts.groupBy("length", "i").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    fits: dict[int, dict[int, tuple[int, int]]] = {}
    for row in total.collect():
        fits.setdefault(row["length"], {})[row["i"]] = row["n"], int(row["s"])
    return {length: Fit(at[0][0], [at[i][1] for i in range(length)]) for length, at in fits.items()}


def _summed(vectors: DataFrame, fits: dict[int, Fit], image) -> dict[int, np.ndarray]:
    """Covariances of ``image(fit, centred)`` by length, from parts that are centred on their own mean before they are
    multiplied; Spark adds the parts entry by entry."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, tuple] = {}
        for batch in batches:
            for _, x in whole(batch.column(1)):
                y = image(fits[x.shape[1]], fits[x.shape[1]].apart(x)[1])
                mean = y.mean(axis=0)
                within = (y - mean).T @ (y - mean)
                count, centre, inner = found.get(x.shape[1], (0, np.zeros_like(mean), np.zeros_like(within)))
                both = count + len(y)
                step = mean - centre
                inner += within + np.outer(step, step) * (count * len(y) / both)
                found[x.shape[1]] = both, centre + step * (len(y) / both), inner
        for length, (count, centre, inner) in found.items():
            for i in range(len(centre)):
                # The mean of all images is zero but for rounding, so the parts' means are what lies between them.
                row = np.append(inner[i] + count * centre[i] * centre, count * centre[i])
                yield pa.RecordBatch.from_pydict({"length": [length], "i": [i], "v": [row]}, pa.schema(_PART))

    parts = vectors.mapInArrow(partial, "length long, i long, v array<double>")
    entries = parts.select("length", "i", F.posexplode("v").alias("j", "e")).groupBy("length", "i", "j").agg(F.sum("e").alias("e"))
    rows = entries.groupBy("length", "i").agg(F.array_sort(F.collect_list(F.struct("j", "e"))).alias("row"))
    found: dict[int, dict[int, list[float]]] = {}
    for r in rows.toLocalIterator():
        found.setdefault(r["length"], {})[r["i"]] = [e for _, e in r["row"]]
    out = {}
    for length, at in found.items():
        table = np.array([at[i] for i in range(len(at))]) / fits[length].count
        mean = table[:, -1]
        matrix = table[:, :-1] - np.outer(mean, mean)
        out[length] = (matrix + matrix.T) / 2
    return out


_PART = [("length", pa.int64()), ("i", pa.int64()), ("v", pa.list_(pa.float64()))]


def clusters(values: np.ndarray, apart: float) -> list[np.ndarray]:
    """Groups of two or more columns whose values, in order, are nearer than ``apart``."""
    order = np.argsort(values)
    cuts = np.flatnonzero(np.diff(values[order]) > apart) + 1
    return [group for group in np.split(order, cuts) if len(group) > 1]


def eigen(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, falling, and unit eigenvectors of a symmetric matrix, refined from a float32 solution."""
    size = np.abs(matrix).max(initial=0.0)
    if not size:
        return np.zeros(len(matrix)), np.eye(len(matrix))
    a = matrix / size
    x = np.linalg.eigh(a.astype(np.float32))[1].astype(np.float64)
    norm = np.linalg.norm(a, 2)
    floor = 4 * len(a) * np.finfo(np.float64).eps * norm
    solved: set[tuple[int, ...]] = set()
    last = np.inf
    for _ in range(_STEPS):
        r = np.eye(len(a)) - x.T @ x
        s = x.T @ (a @ x)
        values = np.diag(s) / (1 - np.diag(r))
        off = s - np.diag(values)
        apart = 2 * (np.linalg.norm(off, 2) + norm * np.linalg.norm(r, 2))
        todo = [c for c in clusters(values, apart) if (*sorted(c),) not in solved and np.abs(off[np.ix_(c, c)]).max() > floor / 4]
        if todo:
            for c in todo:
                # The space is right to a few digits; a small eigenproblem about its mean value parts the columns.
                q = np.linalg.qr(x[:, c])[0]
                inner = q.T @ (a @ q)
                inner = (inner + inner.T) / 2 - np.eye(len(c)) * np.trace(inner) / len(c)
                scale = np.abs(inner).max()
                x[:, c] = q @ np.linalg.eigh(inner / scale)[1] if scale else q
                solved.add((*sorted(c),))
            continue
        gap = values[None, :] - values[:, None]
        far = np.abs(gap) > apart
        step = np.where(far, (s + values[None, :] * r) / np.where(far, gap, 1.0), r / 2)
        x = x + x @ step
        change = np.abs(step).max()
        if change < 1e-15 or last / 2 < change < 1e-8:
            break
        last = change
    for _ in range(3):
        # Where eigenvalues nearly agree the iteration leaves a small skew; the nearest orthonormal columns have none.
        x = x + x @ (np.eye(len(a)) - x.T @ x) / 2
    values = np.einsum("ij,ij->j", x, a @ x)
    order = np.argsort(-values, kind="stable")
    return values[order] * size, x[:, order]


def whitened(
    vectors: DataFrame, *, key: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS
) -> DataFrame:
    """One row per vector that takes part and component: ``key``, component (from 1), n, deviation (decimal), whitened,
    explained, identity_error."""
    vectors = vectors.select(F.col(key).alias("_key"), F.col(vector).cast("array<double>").alias("_vector"))
    fits = _sums(vectors)
    for length, matrix in _summed(vectors, fits, lambda fit, centred: centred).items():
        fit, (values, axes) = fits[length], eigen(matrix)
        kept = np.flatnonzero(values > max(values[0], 0) * _NO_VARIANCE)[:components]
        fit.values, fit.axes, fit.shares = values[kept], axes[:, kept], values[kept] / max(np.trace(matrix), 1e-300)
    for length, matrix in _summed(vectors, fits, lambda fit, centred: fit.whiten(centred)).items():
        fits[length].error = float(np.abs(matrix - np.eye(len(matrix))).max(initial=0.0))
    error = max((fit.error for fit in fits.values()), default=0.0)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for taken, x in whole(batch.column(1)):
                fit = fits[x.shape[1]]
                count, found = len(fit.values), len(taken)
                if not count:
                    continue
                exact, centred = fit.apart(x)
                deviation = squares(exact)
                keys = batch.column(0).take(pa.array(np.repeat(taken, count)))
                columns = [
                    keys, pa.array(np.tile(np.arange(1, count + 1, dtype=np.int32), found)), pa.array(np.full(found * count, fit.count)),
                    pa.array([str(d) for d in deviation]).take(pa.array(np.repeat(np.arange(found), count))),
                    pa.array(fit.whiten(centred).reshape(-1)), pa.array(np.tile(fit.shares, found)),
                    pa.array(np.full(found * count, error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, _ROWS)

    kind = vectors.schema["_key"].dataType.simpleString()
    out = vectors.mapInArrow(
        rows, f"_key {kind}, component int, n long, deviation string, whitened double, explained double, identity_error double"
    )
    return out.withColumn("deviation", F.col("deviation").cast("decimal(38,0)")).withColumnRenamed("_key", key)


_ROWS = ["_key", "component", "n", "deviation", "whitened", "explained", "identity_error"]
