"""Whitening of embeddings: covariance by streaming rank-one updates, eigenvectors by symmetric QR steps.

Entries become integers, floor(64 * c) + 1000000.  Each distinct vector of integers is fitted once: every partition updates its
mean and scatter matrix one vector at a time (Welford), and partitions are merged by the parallel formula in a tree, so the driver and any one
task hold a few states of dimension squared at a time, never vectors.  Means are kept as an exact integer and a small remainder, sums are exact.  The eigenvectors of the covariance
come from a Householder reduction to tridiagonal form and implicit QR steps with Wilkinson shifts.  All rows are then projected
where they lie, and the covariance of the whitened fit list is measured in the same way.

Defined cases: rows whose vector is null, or has null or non-finite entries, are left out, and so are those of another length than
most rows have (ties: the longest); entries beyond 2**40 in size count as that; equal rows each get their results; components without variance (under 1e-12 of the trace,
as when there are fewer distinct vectors than dimensions) don't exist, so one distinct vector alone gives no rows, nor does an empty table; a deviation beyond 64 bits is
null; other columns are carried in `doc`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .arrow_rows import quoted
from .scratch import Scratch

COMPONENTS = 16
SCALE, SHIFT = 64, 1_000_000
LARGEST = float(1 << 40)
#: A component has more than so much of the trace.
RANK_SHARE = 1e-12
#: Levels of the tree in which the states of partitions are merged.
DEPTH = 3


@dataclass
class Moments:
    """Count, mean (base + mean, of integers and a remainder), scatter matrix and, of integers, exact sums."""

    n: int
    base: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray
    sums: np.ndarray

    @classmethod
    def of(cls, vectors: Iterable[np.ndarray]) -> Moments | None:
        """Welford's updates: each vector changes the mean, and the scatter by one outer product."""
        out = None
        for x in vectors:
            if out is None:
                base = np.floor(x)
                out = cls(0, base, np.zeros(len(x)), np.zeros((len(x), len(x))), np.zeros(len(x), x.dtype))
            out.n += 1
            y = (x - out.base).astype(np.float64)
            before = y - out.mean
            out.mean += before / out.n
            out.scatter += np.multiply.outer(before, y - out.mean)
            out.sums += x
        if out is not None:
            out.scatter = (out.scatter + out.scatter.T) / 2
        return out

    def merged(self, other: Moments) -> Moments:
        """The moments of both parts."""
        n = self.n + other.n
        apart = (other.base - self.base).astype(np.float64) + (other.mean - self.mean)
        return Moments(n, self.base, self.mean + apart * (other.n / n), self.scatter + other.scatter + np.multiply.outer(apart, apart) * (self.n * (other.n / n)), self.sums + other.sums)

    @property
    def covariance(self) -> np.ndarray:
        return self.scatter / self.n


def merge(a: Moments | None, b: Moments | None) -> Moments | None:
    return b if a is None else a if b is None else a.merged(b)


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    """Rows of a list column without nulls, all of one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind, copy=False).reshape(len(column), dim)


def moments(vectors: DataFrame, name: str, dim: int, project=None) -> Moments | None:
    """The moments of a list column, of its integers or of what `project` makes of a matrix of them."""

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[np.ndarray]:
            for batch in batches:
                x = _matrix(batch.column(0), dim, np.int64)
                yield from x if project is None else project(x)

        state = Moments.of(rows())
        if state is not None:
            fields = (state.base, state.mean, state.scatter, state.sums)
            yield pa.RecordBatch.from_arrays([pa.array([state.n]), *[pa.array([v.astype(np.float64 if project or i in (1, 2) else np.int64).tobytes()], pa.binary()) for i, v in enumerate(fields)]], names=["n", "base", "mean", "scatter", "sums"])

    exact = np.float64 if project else np.int64

    def state(r: T.Row) -> Moments:
        mean = np.frombuffer(r["mean"])
        return Moments(r["n"], np.frombuffer(r["base"], exact), mean, np.frombuffer(r["scatter"]).reshape(len(mean), len(mean)), np.frombuffer(r["sums"], exact))

    parts = vectors.select(name).mapInArrow(partial, "n long, base binary, mean binary, scatter binary, sums binary")
    return parts.rdd.map(state).treeAggregate(None, merge, merge, DEPTH)  # a row for each partition


def tridiagonal(a: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Householder reflections: (diagonal, off-diagonal, q) with q.T @ a @ q tridiagonal."""
    a, n = a.copy(), len(a)
    q = np.eye(n)
    for k in range(n - 2):
        x = a[k + 1 :, k]
        largest = np.abs(x).max()
        if not np.any(x[1:]):
            continue
        v = x / largest
        v[0] += np.copysign(np.sqrt(v @ v), v[0])
        v /= np.sqrt(v @ v)
        right = a[k + 1 :, k + 1 :]
        p = right @ v
        w = p - (v @ p) * v
        right -= 2 * (np.multiply.outer(v, w) + np.multiply.outer(w, v))
        a[k + 1 :, k] -= 2 * v * (v @ a[k + 1 :, k])
        a[k, k + 1 :] = a[k + 1 :, k]
        q[:, k + 1 :] -= 2 * np.multiply.outer(q[:, k + 1 :] @ v, v)
    return np.diag(a).copy(), np.diag(a, 1).copy(), q


def eigen(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(eigenvalues falling, unit eigenvectors as columns) of a symmetric matrix, by implicit QR steps."""
    n = len(a)
    d, e, q = tridiagonal(np.asarray(a, np.float64))
    z = np.ascontiguousarray(q.T)  # a row for each vector, so rotations work on contiguous ones
    tiny, hi, steps = np.finfo(float).eps, n - 1, 0
    while hi > 0:
        small = np.abs(e[:hi]) <= tiny * (np.abs(d[:hi]) + np.abs(d[1 : hi + 1]))
        e[:hi][small] = 0
        if small[hi - 1]:
            hi, steps = hi - 1, 0
            continue
        steps += 1
        if steps > 100:
            raise ArithmeticError("QR steps don't converge")
        lo = int(np.flatnonzero(small)[-1]) + 1 if small.any() else 0
        half = (d[hi - 1] - d[hi]) / 2
        shift = d[hi] - e[hi - 1] ** 2 / (half + np.copysign(np.hypot(half, e[hi - 1]), half))
        x, y = d[lo] - shift, e[lo]
        for k in range(lo, hi):
            r = np.hypot(x, y)
            c, s = (x / r, y / r) if r else (1.0, 0.0)
            if k > lo:
                e[k - 1] = r
            dk, dn, ek = d[k], d[k + 1], e[k]
            d[k], d[k + 1] = c * c * dk + 2 * c * s * ek + s * s * dn, s * s * dk - 2 * c * s * ek + c * c * dn
            e[k] = c * s * (dn - dk) + (c * c - s * s) * ek
            if k < hi - 1:
                x, y = e[k], s * e[k + 1]
                e[k + 1] *= c
            z[k], z[k + 1] = c * z[k] + s * z[k + 1], c * z[k + 1] - s * z[k]
    order = np.argsort(-d, kind="stable")
    vectors = z[order].T
    return d[order], vectors / np.sqrt((vectors**2).sum(0))


@dataclass
class Whitening:
    """A fitted transformation; `vectors` has a column for each component that exists."""

    n: int
    sums: np.ndarray
    values: np.ndarray
    vectors: np.ndarray
    trace: float

    @classmethod
    def fitted(cls, state: Moments, components: int = COMPONENTS) -> Whitening:
        v = state.covariance
        trace = float(np.trace(v))
        values, vectors = eigen(v)
        k = int((values[:components] > RANK_SHARE * trace).sum()) if trace > 0 else 0
        return cls(state.n, state.sums, values[:k], np.ascontiguousarray(vectors[:, :k]), trace)

    def project(self, x: np.ndarray) -> np.ndarray:
        centred = (x * self.n - self.sums) / self.n if _fits(self.n, x, self.sums) else x - self.sums / self.n
        return centred @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int | None]:
        """The sum over dimensions of (n * x - sum) ** 2, exact."""
        rough = ((x.astype(np.float64) * self.n - self.sums) ** 2).sum(1)
        if _fits(self.n, x, self.sums) and (not len(rough) or rough.max() < 2.0**62):
            return ((x * self.n - self.sums) ** 2).sum(1).tolist()
        exact = (((x.astype(object) * self.n - self.sums.astype(object)) ** 2).sum(1)).tolist()
        return [v if v < 1 << 63 else None for v in exact]


def _fits(n: int, x: np.ndarray, sums: np.ndarray) -> bool:
    """Whether n * x - sums can be computed in 64 bits."""
    return not x.size or float(np.abs(x).max()) * n + float(np.abs(sums).max()) < 2.0**62


def grid(vector: Column) -> Column:
    """The integers of a vector."""
    bounded = lambda c: F.greatest(F.least(c.cast("double"), F.lit(LARGEST)), F.lit(-LARGEST))
    return F.transform(vector, lambda c: F.floor(bounded(c) * SCALE) + F.lit(SHIFT).cast("long"))


def usable(vector: Column) -> Column:
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))
    return F.coalesce(F.forall(vector, finite), F.lit(False))


def whiten(rows: DataFrame, vector: str = "embedding", components: int = COMPONENTS, carry: Sequence[str] | None = None) -> DataFrame:
    """(doc, n, deviation, whitened, explained, identity_error): whitened and explained have an entry for each component."""
    spark, scratch = rows.sparkSession, Scratch(rows.sparkSession, "whitening")
    columns = rows.columns if carry is None else list(carry)
    v = F.col(quoted(vector))
    kept = rows.filter(usable(v)).select(F.struct(*[F.col(quoted(c)) for c in columns]).alias("doc"), grid(v).alias("x"))
    fields = T._parse_datatype_string("n long, deviation long, whitened array<double>, explained array<double>, identity_error double").fields
    schema = T.StructType([kept.schema["doc"], *fields])
    empty = spark.createDataFrame([], schema)

    most = kept.groupBy(F.size("x").alias("dim")).count().orderBy(F.desc("count"), F.desc("dim")).first()
    if most is None or not most["dim"]:
        return empty
    dim = most["dim"]
    kept = kept.filter(F.size("x") == dim)
    fit = scratch.keep(kept.select("x").distinct(), "fit")
    model = Whitening.fitted(moments(fit, "x", dim), components)
    if not len(model.values):
        return empty
    identity = moments(fit, "x", dim, model.project).covariance - np.eye(len(model.values))
    error, explained = float(np.abs(identity).max()), (model.values / model.trace).tolist()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), dim, np.int64)
            if not len(x):
                continue
            flat = pa.array(model.project(x).ravel())
            k = len(model.values)
            listed = pa.ListArray.from_arrays(pa.array(np.arange(0, k * len(x) + 1, k), pa.int32()), flat)
            columns = [pa.array([model.n] * len(x)), pa.array(model.deviation(x), pa.int64()), listed, pa.array([explained] * len(x)), pa.array([error] * len(x))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=schema.names)

    return kept.mapInArrow(run, schema)
