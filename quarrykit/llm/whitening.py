"""Whitening of embeddings by spectrum slicing.

Entries become whole numbers, so n, sums and second moments are exact: tasks sum integers that were
centred on the rounded mean before they are multiplied, Spark adds the tasks' sums as decimals, and
the covariance is rounded once, at the end. What reaches the driver is one matrix of dimension by
dimension, whatever the number of rows. There the leading eigenvalues are isolated by bisection:
the signs in a Bunch-Kaufman LDL' factorisation of the shifted matrix count the eigenvalues above a
shift (Sylvester's law of inertia). Inside its interval each eigenvalue is found by Rayleigh
quotient iteration, which converges cubically, and two more counts certify its number. Eigenvalues
that no shift can part are taken together, by inverse iteration on a block of vectors.

Defined results: rows whose vector is null, or holds null, non-finite entries or such of 2^47 and
more, are left out; so are vectors shorter or longer than most (ties: than the shorter), and empty
ones. Repeated vectors count once in the fit and each row has its own results; rows may repeat a
vec_id or have none. Fewer components than asked come out where the matrix has no more variance; a
table with fewer than two different vectors gives no rows. ``deviation`` is null beyond 64 bits.
Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarrykit.session import stored

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
#: Entries of this size and more have no exact place among the whole numbers.
LARGEST = 1 << 47
_EXACT = 1 << 53


def whole_numbers(vector: Column) -> Column:
    """floor(64 * c) + 1000000 of each entry, as longs."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * SCALE).cast("bigint") + SHIFT)


def usable(vector: Column) -> Column:
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float(LARGEST)))


def _matrix(column: pa.Array, d: int) -> np.ndarray:
    return column.values[column.offsets[0].as_py() : column.offsets[-1].as_py()].to_numpy().reshape(-1, d)


def _products(z: np.ndarray) -> np.ndarray:
    """z' z in exact Python integers; by floating point where no sum can be rounded."""
    most = int(np.abs(z).max(initial=0))
    total = np.zeros((z.shape[1], z.shape[1]), object)
    if most * most >= _EXACT:
        wide = z.astype(object)
        return total + wide.T @ wide
    step = max(1, min(len(z), _EXACT // max(1, most * most)))
    for at in range(0, len(z), step):
        part = z[at : at + step].astype(np.float64)
        total += (part.T @ part).astype(np.int64).astype(object)
    return total


def _sums(d: int):
    """(i, v): exact sums of each dimension in a task, and the number of rows at i = d."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(d, object), 0
        for batch in batches:
            x = _matrix(batch.column(0), d)
            high, low = x >> 24, x & 0xFFFFFF  # two sums that 64 bits hold
            sums += high.sum(axis=0).astype(object) * (1 << 24) + low.sum(axis=0).astype(object)
            n += len(x)
        yield pa.RecordBatch.from_arrays([pa.array(range(d + 1), pa.int32()), pa.array([Decimal(int(v)) for v in [*sums, n]], pa.decimal128(38, 0))], names=["i", "v"])

    return run


def _moments(d: int, centre: list[int]):
    """(i, j, v): exact sums of products of entries about an integer centre in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, columns = np.triu_indices(d)
        total = np.zeros((d, d), object)
        for batch in batches:
            total += _products(_matrix(batch.column(0), d) - np.array(centre, np.int64))
        yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array(columns, pa.int32()), pa.array([Decimal(int(v)) for v in total[rows, columns]], pa.decimal128(38, 0))], names=["i", "j", "v"])

    return run


def above(matrix: np.ndarray, shift: float) -> int:
    """Eigenvalues greater than ``shift``: positive signs of D in LDL' of the shifted matrix, pivoted after Bunch and Kaufman."""
    a = matrix - shift * np.eye(len(matrix))
    n, k, count, alpha = len(a), 0, 0, (1 + 17**0.5) / 8
    nothing = np.abs(a).max(initial=0.0) * np.finfo(float).eps ** 2

    def swap(i: int, j: int) -> None:
        if i != j:
            a[[i, j], k:] = a[[j, i], k:]
            a[k:, [i, j]] = a[k:, [j, i]]

    while k < n:
        below = np.abs(a[k + 1 :, k])
        most = below.max(initial=0.0)
        size, own = 1, abs(a[k, k])
        if max(most, own) <= nothing:
            k += 1
            continue
        if own < alpha * most:
            r = k + 1 + int(below.argmax())
            other = np.abs(a[r, k:]).copy()
            other[r - k] = 0
            if own * other.max() < alpha * most * most:
                if abs(a[r, r]) >= alpha * other.max():
                    swap(k, r)
                else:
                    swap(k + 1, r)
                    size = 2
        if size == 1:
            count += int(a[k, k] > 0)
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k + 1 :, k]) / a[k, k]
        else:  # such a block has one eigenvalue of either sign
            count += 1
            side = a[k + 2 :, k : k + 2]
            update = side @ np.linalg.solve(a[k : k + 2, k : k + 2], side.T)
            a[k + 2 :, k + 2 :] -= (update + update.T) / 2  # symmetric to the last bit
        k += size
    return count


def _solve(matrix: np.ndarray, shift: float, right: np.ndarray, least: float) -> np.ndarray:
    for step in (0.0, least, 7 * least):
        try:
            out = np.linalg.solve(matrix - (shift + step) * np.eye(len(matrix)), right)
        except np.linalg.LinAlgError:
            continue
        if np.isfinite(out).all():
            return out
    raise ArithmeticError("the shifted matrix cannot be solved")


class Slices:
    """Leading eigenpairs of a symmetric matrix."""

    def __init__(self, matrix: np.ndarray):
        self.matrix, self.counts = matrix, {}
        radius = np.abs(matrix).sum(axis=1)
        self.norm = float(radius.max(initial=0.0))
        self.least = 4 * len(matrix) * np.finfo(float).eps * self.norm  # eigenvalues closer than this are one cluster

    def above(self, shift: float) -> int:
        if shift not in self.counts:
            self.counts[shift] = above(self.matrix, shift)
        return self.counts[shift]

    def slice_of(self, k: int) -> tuple[float, float]:
        """An interval with eigenvalue ``k`` (from 1, falling) alone, or with its cluster, and about as wide as the gaps around it allow."""
        low, high = -self.norm * 1.01, self.norm * 1.01
        for shift, count in self.counts.items():  # what earlier counts say
            low, high = (max(low, shift), high) if count >= k else (low, min(high, shift))
        after = 0
        while high - low > self.least and after < 8:
            middle = (low + high) / 2
            if self.above(middle) >= k:
                low = middle
            else:
                high = middle
            after += self.above(low) == k and self.above(high) == k - 1
        low, high, step = min(low, high), max(low, high), self.least  # counts may cross within rounding
        while self.above(low) < k:
            low, step = low - step, 2 * step
        while self.above(high) >= k:
            high, step = high + step, 2 * step
        return low, high

    def pair(self, k: int, low: float, high: float) -> tuple[float, np.ndarray]:
        """Rayleigh quotient iteration for an isolated eigenvalue; a quotient that leaves the interval narrows it and begins anew."""
        start = np.random.default_rng(k).standard_normal(len(self.matrix))
        while True:
            shift, x, before = (low + high) / 2, start, np.inf
            for turn in range(30):
                x = _solve(self.matrix, shift, x, self.least)
                x /= np.linalg.norm(x)
                value = float(x @ self.matrix @ x)
                left = float(np.linalg.norm(self.matrix @ x - value * x))
                if turn >= 2:  # two steps of plain inverse iteration lead into the interval
                    if not low <= value <= high:
                        break
                    if left <= self.least / 8 or left >= before:
                        return value, x
                    shift, before = value, left
            if high - low <= self.least:
                return value, x
            middle = (low + high) / 2
            low, high = (middle, high) if self.above(middle) >= k else (low, middle)

    def cluster(self, low: float, high: float, size: int) -> tuple[np.ndarray, np.ndarray]:
        """Eigenpairs that no count can part: inverse iteration on a block of vectors."""
        x = np.random.default_rng(size).standard_normal((len(self.matrix), size))
        for _ in range(4):
            x, _ = np.linalg.qr(_solve(self.matrix, (low + high) / 2, x, self.least))
        values, turned = np.linalg.eigh(x.T @ self.matrix @ x)
        return values[::-1], (x @ turned)[:, ::-1]

    def certified(self, k: int, value: float) -> bool:
        return self.above(value - 2 * self.least) >= k > self.above(value + 2 * self.least)


def leading(matrix: np.ndarray, most: int = COMPONENTS) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) with variance; each vector's entry of largest size is positive."""
    of, values, vectors, k = Slices(matrix), [], [], 1
    while of.norm and k <= min(most, len(matrix)):
        low, high = of.slice_of(k)
        size = of.above(low) - of.above(high)
        k = of.above(high) + 1  # the cluster's first, should it reach back
        del values[k - 1 :], vectors[k - 1 :]
        if size == 1:
            value, vector = of.pair(k, low, high)
            found = [(value, vector)]
        else:
            found = list(zip(*(lambda v, x: (v.tolist(), x.T))(*of.cluster(low, high, size)), strict=True))
        for value, vector in found:
            if value <= of.least or k > most:
                return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix)).T
            if not of.certified(k, value):
                raise ArithmeticError(f"eigenvalue {k} could not be certified")
            for v in vectors:  # rounding only
                vector = vector - (v @ vector) * v
            vector = vector / np.linalg.norm(vector)
            vectors.append(vector * np.sign(vector[np.abs(vector).argmax()]))
            values.append(value)
            k += 1
    return np.array(values), np.array(vectors).reshape(len(vectors), len(matrix)).T


class Fit(NamedTuple):
    n: int
    sums: list[int]
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    def centred(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """n * x - S exactly, and x - S / n rounded once."""
        most = self.n * int(np.abs(x).max(initial=0)) + max(map(abs, self.sums), default=0)
        kind = np.int64 if most < 1 << 62 else object
        exact = self.n * x.astype(kind) - np.array(self.sums, kind)
        if kind is object:
            return exact, np.array([[int(v) / self.n for v in row] for row in exact], float).reshape(x.shape)
        return exact, exact / self.n

    def whitened(self, centred: np.ndarray) -> np.ndarray:
        return centred @ self.vectors / np.sqrt(self.values)


def fit(distinct: DataFrame, d: int, components: int = COMPONENTS) -> Fit:
    """Exact moments of a table of distinct vectors ``x`` and the leading eigenpairs of their covariance."""
    totals = {r["i"]: int(r["v"]) for r in distinct.mapInArrow(_sums(d), "i int, v decimal(38,0)").groupBy("i").agg(F.sum("v").alias("v")).collect()}
    n, sums = totals.get(d, 0), [totals.get(i, 0) for i in range(d)]
    if not n:
        return Fit(0, sums, np.zeros(0), np.zeros((d, 0)), 0.0)
    centre = [round(s / n) if s < _EXACT else s // n for s in sums]
    rest = [s - n * c for s, c in zip(sums, centre, strict=True)]
    covariance = np.zeros((d, d))
    for r in distinct.mapInArrow(_moments(d, centre), "i int, j int, v decimal(38,0)").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        covariance[r["i"], r["j"]] = covariance[r["j"], r["i"]] = (n * int(r["v"]) - rest[r["i"]] * rest[r["j"]]) / (n * n)
    values, vectors = leading(covariance, components)
    return Fit(n, sums, values, vectors.reshape(d, len(values)), float(np.trace(covariance)))


def identity_error(distinct: DataFrame, d: int, model: Fit) -> float:
    """Largest entry of the whitened vectors' covariance, as they come out, minus the identity."""
    k = len(model.values)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((k + 1, k))
        for batch in batches:
            w = model.whitened(model.centred(_matrix(batch.column(0), d))[1])
            total[:k] += w.T @ w
            total[k] += w.sum(axis=0)
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel(), pa.int32()), pa.array(j.ravel(), pa.int32()), pa.array(total.ravel())], names=["i", "j", "v"])

    total = np.zeros((k + 1, k))
    for r in distinct.mapInArrow(run, "i int, j int, v double").groupBy("i", "j").agg(F.sum("v").alias("v")).collect():
        total[r["i"], r["j"]] = r["v"]
    mean = total[k] / model.n
    return float(np.abs(total[:k] / model.n - np.outer(mean, mean) - np.eye(k)).max())


SCHEMA = "vec_id bigint, component int, n bigint, deviation bigint, whitened double, explained double, identity_error double"


def whiten(embeddings: DataFrame, *, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """A row for each usable vector and component: SCHEMA."""
    spark = embeddings.sparkSession
    held = embeddings.select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(vector_col).alias("v")).where(usable(F.col("v")) & (F.size("v") > 0)).select("vec_id", whole_numbers(F.col("v")).alias("x"))
    sizes = held.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if sizes is None:
        return spark.createDataFrame([], SCHEMA)
    d = sizes["d"]
    held = held.where(F.size("x") == d)
    distinct = stored(held.select("x").distinct(), "vectors")
    model = fit(distinct, d, components)
    k = len(model.values)
    if not k:
        return spark.createDataFrame([], SCHEMA)
    error = identity_error(distinct, d, model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            exact, centred = model.centred(_matrix(batch.column(1), d))
            if d * int(np.abs(exact).max(initial=0)) ** 2 < 1 << 63:
                deviation = pa.array((exact * exact).sum(axis=1).astype(np.int64))
            else:
                deviation = pa.array([v if v < 1 << 63 else None for v in map(int, (exact.astype(object) ** 2).sum(axis=1))], pa.int64())
            n, at = len(exact), np.repeat(np.arange(len(exact)), k)
            columns = [
                batch.column(0).take(pa.array(at)),
                pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), n)),
                pa.array(np.full(n * k, model.n, np.int64)),
                deviation.take(pa.array(at)),
                pa.array(model.whitened(centred).ravel()),
                pa.array(np.tile(model.values / model.trace, n)),
                pa.array(np.full(n * k, error)),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

    return held.mapInArrow(run, SCHEMA)
