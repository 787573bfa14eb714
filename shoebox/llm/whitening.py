"""Embedding whitening by pivoted Cholesky and one-sided Jacobi (operator 11).

Entries c become integers x = floor(64 c) + 1000000. One pass sums x, a second one the products of x about the rounded
mean, so that the scatter n * n * V is known in whole numbers before it is divided; both as partial sums of a task that
Spark adds up. On the driver, where only numbers of the vector's length squared go, pivoted Cholesky turns V into a
triangular factor, as many columns as V has rank, and one-sided Jacobi rotates the factor's columns until they are
orthogonal: their squared norms are V's eigenvalues and the normalised columns its eigenvectors, small ones as exact as
large ones. A third pass projects all rows; the covariance of what came out is measured over all rows in a fourth.

Defined cases: a vector that is null or empty, or holds null or non-finite entries (or entries of 2**47 or more, whose
integers doubles can't tell apart) is dropped; vectors are fitted and whitened among those of their length; V's
directions without variance are no components, so one row alone, or equal rows, give nothing; a component's largest
entry is positive; rows without an id and repeated rows are ordinary rows; an empty table gives an empty result; other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shoebox.llm.near_vectors import matrix
from shoebox.llm.tables import discard, materialize

SCALE, SHIFT, COMPONENTS, LARGEST = 64.0, 1_000_000, 32, 2.0**47
#: Whole numbers up to this add up exactly in double precision.
EXACT = 2.0**53


def pivoted_cholesky(v: np.ndarray) -> np.ndarray:
    """Columns of L with L @ L.T == v, one for each of v's rank; row i of L belongs to row i of v.

    The next pivot is the largest variance that the columns so far leave; what is left of a variance by rounding alone
    is none.
    """
    left, own = np.diag(v).copy(), np.diag(v)
    noise = len(v) * np.finfo(float).eps * own
    columns = np.zeros((len(v), len(v)))
    for k in range(len(v)):
        p = int(np.argmax(np.where(left > noise, left, -1)))
        if left[p] <= noise[p]:
            return columns[:, :k]
        column = (v[:, p] - columns[:, :k] @ columns[p, :k]) / np.sqrt(left[p])
        column[left < 0] = 0  # rows that were pivots before
        columns[:, k] = column
        left = left - column**2
        left[p] = -np.inf
    return columns


def one_sided_jacobi(columns: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """The columns rotated among themselves until all are orthogonal. A round rotates disjoint pairs; a sweep of rounds
    brings every two columns together once."""
    w = np.ascontiguousarray(columns.T)
    if len(w) % 2:
        w = np.vstack((w, np.zeros((1, w.shape[1]))))
    order, tolerance = np.arange(len(w)), max(columns.shape) * np.finfo(float).eps
    for _ in range(sweeps if len(w) > 1 else 0):
        most = 0.0
        for _ in range(len(w) - 1):
            p, q = order[: len(w) // 2], order[len(w) // 2 :][::-1]
            a, b = w[p], w[q]
            aa, bb, ab = (a * a).sum(1), (b * b).sum(1), (a * b).sum(1)
            scale = np.sqrt(aa * bb)
            turns = np.abs(ab) > tolerance * scale
            if turns.any():
                most = max(most, float((np.abs(ab[turns]) / scale[turns]).max()))
                zeta = (bb[turns] - aa[turns]) / (2 * ab[turns])
                t = np.where(zeta < 0, -1.0, 1.0) / (np.abs(zeta) + np.hypot(1, zeta))
                c = (1 / np.hypot(1, t))[:, None]
                s = c * t[:, None]
                w[p[turns]], w[q[turns]] = c * a[turns] - s * b[turns], s * a[turns] + c * b[turns]
            order = np.concatenate((order[:1], order[-1:], order[1:-1]))
        if not most:
            break
    return w.T[:, : columns.shape[1]]


@dataclass(frozen=True)
class Whitener:
    """What one vector length's rows were fitted to. `center` is the rounded mean, `rest` what the sums have beyond it."""

    n: int
    center: np.ndarray
    rest: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float

    @staticmethod
    def fit(n: int, sums: list[int], center: np.ndarray, products: list[list[int]], most: int) -> Whitener:
        rest = [s - n * int(c) for s, c in zip(sums, center)]
        v = np.array([[(n * g - a * b) / (n * n) for g, b in zip(row, rest)] for row, a in zip(products, rest)])
        w = one_sided_jacobi(pivoted_cholesky(v))
        values = (w * w).sum(0)
        order = np.argsort(-values, kind="stable")[:most]
        vectors = (w[:, order] / np.sqrt(values[order])).T
        for row in vectors:
            row *= np.sign(row[np.argmax(np.abs(row))])
        return Whitener(n, center, rest, vectors, values[order], float(np.trace(v)))

    def project(self, x: np.ndarray) -> np.ndarray:
        mean = np.array([r / self.n for r in self.rest])
        return (x - self.center - mean) @ (self.components / np.sqrt(self.values)[:, None]).T

    def deviations(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of (n * x - sum)**2, in whole numbers of any size."""
        y = x - self.center
        largest = self.n * float(np.abs(y).max(initial=0)) + max((abs(r) for r in self.rest), default=0)
        kind = np.int64 if largest * largest * x.shape[1] < 2.0**62 else object
        moved = y.astype(kind) * self.n - np.array(self.rest, kind)
        return (moved * moved).sum(1).tolist()


def _by_length(batch: pa.RecordBatch) -> Iterator[tuple[int, pa.RecordBatch, np.ndarray]]:
    dims = np.asarray(batch.column("dim"))
    for d in np.unique(dims):
        part = batch.filter(pa.array(dims == d))
        yield int(d), part, matrix(part.column("x")).astype(np.int64)


def _cells(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    dims, i, j, values = zip(*out) if out else ((), (), (), ())
    yield pa.RecordBatch.from_arrays([pa.array(dims, pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array([Decimal(v) for v in values], pa.decimal128(38, 0))], ["dim", "i", "j", "value"])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's number of rows of each length (at i = -1), and its sums of their entries."""
    held: dict[int, list[int]] = {}
    for batch in batches:
        for d, part, x in _by_length(batch):
            own = held.setdefault(d, [0] * (d + 1))
            for at, add in enumerate([len(part), *x.sum(0).tolist()]):  # a batch's sums fit 64 bits: entries stay under 2**53
                own[at] += add
    yield from _cells([(d, at - 1, 0, v) for d, own in held.items() for at, v in enumerate(own)])


def whiten(vectors: DataFrame, most: int = COMPONENTS, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(id, component, n, deviation, whitened, explained, identity_error) for each row and component."""
    spark, kind = vectors.sparkSession, dict(vectors.select(F.col(id_col).alias("id")).dtypes)["id"]
    cells = "dim int, i int, j int, value decimal(38,0)"
    rows = vectors.select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    fits = F.coalesce(F.forall("vector", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < LARGEST)), F.lit(False)) & (F.size("vector") > 0)
    rows = rows.where(fits).select("id", F.size("vector").alias("dim"), F.transform("vector", lambda c: F.floor(c * SCALE).cast("long") + SHIFT).alias("x"))
    rows = materialize(rows, "whiten-rows")

    numbers, sums = {}, {}
    for r in rows.select("dim", "x").mapInArrow(_sums, cells).groupBy("dim", "i").agg(F.sum("value").alias("value")).orderBy("dim", "i").toLocalIterator():
        if r.i < 0:
            numbers[r.dim] = int(r.value)
        else:
            sums.setdefault(r.dim, []).append(int(r.value))
    centers = {d: np.array([s // numbers[d] for s in sums[d]], np.int64) for d in sums}
    sent = spark.sparkContext.broadcast(centers)

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A task's sums of products about the center: exact as doubles up to EXACT, then kept as whole numbers."""
        held: dict[int, tuple[np.ndarray, np.ndarray, float]] = {}
        for batch in batches:
            for d, _, x in _by_length(batch):
                y = (x - sent.value[d]).astype(np.float64)
                more = len(y) * float(np.abs(y).max()) ** 2
                whole, part, bound = held.get(d) or (np.zeros((d, d), object), np.zeros((d, d)), 0.0)
                if bound + more >= EXACT:
                    whole, part, bound = whole + _whole(part), np.zeros((d, d)), 0.0
                held[d] = (whole, part + y.T @ y, bound + more)
        for d, (whole, part, _) in held.items():
            total = whole + _whole(part)
            yield from _cells([(d, i, j, total[i, j]) for i in range(d) for j in range(i + 1)])

    scatter: dict[int, list[list[int]]] = {d: [[0] * d for _ in range(d)] for d in sums}
    for r in rows.select("dim", "x").mapInArrow(products, cells).groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).toLocalIterator():
        scatter[r.dim][r.i][r.j] = scatter[r.dim][r.j][r.i] = int(r.value)
    fitted = {d: Whitener.fit(numbers[d], sums[d], centers[d], scatter.pop(d), most) for d in sums}
    models = spark.sparkContext.broadcast(fitted)

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for d, part, x in _by_length(batch):
                z = models.value[d].project(x)
                at = pa.array(np.arange(len(z) + 1) * z.shape[1], pa.int32())
                deviation = pa.array([Decimal(v) for v in models.value[d].deviations(x)], pa.decimal128(38, 0))
                yield pa.RecordBatch.from_arrays([part.column("id"), part.column("dim"), deviation, pa.ListArray.from_arrays(at, pa.array(z.ravel()))], ["id", "dim", "deviation", "z"])

    projected = materialize(rows.mapInArrow(project, f"id {kind}, dim int, deviation decimal(38,0), z array<double>"), "whiten-projected")
    discard(rows)
    errors = dict.fromkeys(fitted, 0.0)
    moments: dict[int, np.ndarray] = {d: np.zeros((len(f.values) + 1, len(f.values) + 1)) for d, f in fitted.items()}
    for r in projected.select("dim", "z").mapInArrow(_moments, "dim int, i int, j int, value double").groupBy("dim", "i", "j").agg(F.sum("value").alias("value")).toLocalIterator():
        moments[r.dim][r.i, r.j] = r.value
    for d, m in moments.items():
        mean = m[0, 1:] / numbers[d]
        errors[d] = float(np.abs(m[1:, 1:] / numbers[d] - np.outer(mean, mean) - np.eye(len(mean))).max(initial=0))
    facts = spark.createDataFrame(
        [(d, i + 1, f.n, float(e / f.trace), errors[d]) for d, f in fitted.items() for i, e in enumerate(f.values)], "dim int, component int, n long, explained double, identity_error double"
    )  # at most `most` rows for each length
    out = projected.select("id", "dim", "deviation", F.posexplode("z").alias("at", "whitened")).withColumn("component", F.col("at") + 1).join(facts, ["dim", "component"])
    return out.select(F.col("id").alias(id_col), "component", "n", "deviation", "whitened", "explained", "identity_error")


def _whole(part: np.ndarray) -> np.ndarray:
    return np.array([int(v) for v in part.ravel()], object).reshape(part.shape)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sums of whitened rows (row and column 0) and of their products; such rows lie about zero already."""
    held: dict[int, np.ndarray] = {}
    for batch in batches:
        dims = np.asarray(batch.column("dim"))
        for d in np.unique(dims):
            z = matrix(batch.filter(pa.array(dims == d)).column("z"))
            one = np.concatenate((np.ones((len(z), 1)), z), axis=1)
            held[int(d)] = held.get(int(d), 0) + one.T @ one
    for d, m in held.items():
        i, j = (a.ravel() for a in np.indices(m.shape))
        yield pa.RecordBatch.from_arrays([pa.array(np.full(m.size, d), pa.int32()), pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(m.ravel())], ["dim", "i", "j", "value"])
