"""Whitening of embeddings: two passes for the covariance, then a broadcast projection onto its eigenvectors.

An entry c counts as the integer x = floor(64 * c) + 1000000. The first pass sums these exactly (two halves of each
integer, then Python's integers), which gives the mean as a fraction S / n. The second pass takes blocks of rows less
that mean, its whole part as integers and only the rest in floating point, multiplies each block by itself (GEMM) and
adds the products; partial sums, one d x d matrix for each task, are merged by treeAggregate. LAPACK's symmetric solver
gives the eigenvectors. A third pass measures what came out: the covariance of the whitened rows, centred block by block,
against the identity. The driver and a task hold d x d numbers at most, however many rows there are.

Defined cases: rows whose vector is null, empty or holds a null, NaN or infinite entry are left out. All vectors of a fit
have one length: the one that most of the remaining rows have (of several, the longest); rows of other lengths are left out, too.
Entries beyond 2 ** 55 in size count as that. Equal rows and equal ids stay separate rows; a null id stays null. A
direction in which the rows don't differ (its eigenvalue is 0 in double precision) can't be whitened and has no rows, so
a single row or equal rows give an empty result, as an empty table does. A deviation that no long holds is null. Other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

SCALE = 64
SHIFT = 1_000_000
COMPONENTS = 32
#: Of 64 * c; x stays a long.
LARGEST = float(1 << 61)
SCHEMA = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def _finite(arr: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Entries of all vectors as doubles, where each vector starts and ends, and which vectors are without gaps."""
    if isinstance(arr, pa.ChunkedArray):
        arr = arr.combine_chunks()
    off = arr.offsets.to_numpy().astype(np.int64)
    flat = arr.values.cast(pa.float64())
    good = np.isfinite(flat.to_numpy(zero_copy_only=False))  # a null entry is NaN here
    bad = np.concatenate([[0], np.cumsum(~good)])
    whole = (bad[off[1:]] == bad[off[:-1]]) & (np.diff(off) > 0) & arr.is_valid().to_numpy(zero_copy_only=False)
    return flat.to_numpy(zero_copy_only=False), off, whole


def integers(arr: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of arr that are vectors of d finite entries, and these entries as integers."""
    flat, off, whole = _finite(arr)
    rows = np.flatnonzero(whole & (np.diff(off) == d))
    c = flat[off[rows][:, None] + np.arange(d)]
    return rows, np.clip(np.floor(SCALE * c), -LARGEST, LARGEST).astype(np.int64) + SHIFT


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(d, n, sums): for each length of vectors their number and their exact sums by dimension."""
    found: dict[int, list] = {}
    for b in batches:
        _, off, whole = _finite(b.column(0))
        for d in np.unique(np.diff(off)[whole]).tolist():
            rows, x = integers(b.column(0), d)
            high, low = (x >> 32).sum(0), (x & 0xFFFFFFFF).sum(0)
            total = high.astype(object) * (1 << 32) + low.astype(object)
            n, before = found.get(d, (0, 0))
            found[d] = (n + len(rows), before + total)
    rows = [(d, n, pickle.dumps(list(s))) for d, (n, s) in found.items()]
    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.binary()))], ["d", "n", "sums"])


class _Centre:
    """The exact mean S / n of n vectors, and what is measured from it."""

    def __init__(self, n: int, sums: list[int]) -> None:
        self.n, self.d = n, len(sums)
        self.whole = np.array([s // n for s in sums], np.int64)
        self.rest = [s % n for s in sums]
        self.fraction = np.array([r / n for r in self.rest])

    def centred(self, x: np.ndarray) -> np.ndarray:
        return (x - self.whole).astype(np.float64) - self.fraction

    def deviations(self, x: np.ndarray) -> pa.Array:
        """Sum over dimensions of (n x - S) ** 2 of each row, exactly; null beyond a long."""
        y = x - self.whole
        most = max(int(np.abs(y).max(initial=0)), 1)
        if (self.n * (most + 1)) ** 2 * self.d < 1 << 63:
            return pa.array(((self.n * y - np.array(self.rest, np.int64)) ** 2).sum(1))
        # n ** 2 * sum(y ** 2) - 2 * n * sum(y * rest) + sum(rest ** 2)
        small = most * max(most, self.n) * self.d < 1 << 62
        y = y if small else y.astype(object)
        rest = np.array(self.rest, np.int64 if small else object)
        square, mixed = (y * y).sum(1).astype(object), (y * rest).sum(1).astype(object)
        exact = self.n * self.n * square - 2 * self.n * mixed + sum(r * r for r in self.rest)
        return pa.array([v if v < 1 << 63 else None for v in exact.tolist()], pa.int64())


def _products(centre):
    """One row for each task: the sum of the outer products of its centred rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = centre.value
        total = np.zeros((at.d, at.d))
        for b in batches:
            _, x = integers(b.column(0), at.d)
            c = at.centred(x)
            total += c.T @ c
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["m"])

    return run


def _moments(centre, projection):
    """One row for each task: number, means and centred products of its whitened rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn = centre.value, projection.value
        found = None
        for b in batches:
            _, x = integers(b.column(0), at.d)
            if len(x):
                w = at.centred(x) @ turn
                mean = w.mean(0)
                found = _merged(found, (len(w), mean, (w - mean).T @ (w - mean)))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(found)], pa.binary())], ["m"])

    return run


def _merged(a, b):
    """Moments of two sets of rows together."""
    if a is None or b is None:
        return b if a is None else a
    (n, mean, m), (k, other, p) = a, b
    gap = other - mean
    return n + k, mean + gap * (k / (n + k)), m + p + np.outer(gap, gap) * (n * k / (n + k))


def _plus(a, b):
    return b if a is None else a if b is None else a + b


def _whitened(centre, projection, explained: list[float]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, turn = centre.value, projection.value
        k = turn.shape[1]
        for b in batches:
            rows, x = integers(b.column(1), at.d)
            each = np.repeat(np.arange(len(rows)), k)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0).take(pa.array(rows)).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(rows))),
                    at.deviations(x).take(pa.array(each)),
                    pa.array((at.centred(x) @ turn).ravel()),
                    pa.array(np.tile(explained, len(rows))),
                ],
                ["vec_id", "component", "deviation", "whitened", "explained"],
            )

    return run


def eigen(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues of a symmetric matrix that aren't 0, falling, and unit eigenvectors; the largest entry of each is positive."""
    e, u = np.linalg.eigh((v + v.T) / 2)
    e, u = e[::-1], u[:, ::-1]
    keep = e > max(e[0], 0) * len(e) * np.finfo(float).eps
    e, u = e[keep], u[:, keep]
    return e, u * np.sign(u[np.abs(u).argmax(0), np.arange(u.shape[1])])


def whiten(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """(vec_id, component, n, deviation, whitened, explained, identity_error): a row for each vector and component."""
    spark = vectors.sparkSession
    C.batch_rows(spark)
    only = vectors.select(F.col(vector_col).alias("v"))
    sums = C.materialize(only.mapInArrow(_sums, "d int, n long, sums binary"))
    best = sums.groupBy("d").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), F.desc("d")).first()
    if best is None:
        return spark.createDataFrame([], SCHEMA)
    parts = sums.where(F.col("d") == best["d"]).select("sums").rdd.map(lambda r: np.array(pickle.loads(r[0]), object))
    centre = spark.sparkContext.broadcast(_Centre(best["n"], list(parts.treeAggregate(None, _plus, _plus))))

    d = best["d"]
    blocks = only.mapInArrow(_products(centre), "m binary").rdd.map(lambda r: np.frombuffer(r[0]).reshape(d, d))
    v = blocks.treeAggregate(None, _plus, _plus) / best["n"]
    e, u = eigen(v)
    if not len(e):
        return spark.createDataFrame([], SCHEMA)
    projection = spark.sparkContext.broadcast(u[:, :components] / np.sqrt(e[:components]))

    moments = only.mapInArrow(_moments(centre, projection), "m binary").rdd.map(lambda r: pickle.loads(r[0]))
    n, _, m = moments.treeAggregate(None, _merged, _merged)
    error = float(np.abs(m / n - np.eye(len(m))).max())
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("v"))
    out = rows.mapInArrow(_whitened(centre, projection, (e / np.trace(v))[:components].tolist()), "vec_id long, component int, deviation long, whitened double, explained double")
    return out.select("vec_id", "component", F.lit(best["n"]).cast("long").alias("n"), "deviation", "whitened", "explained", F.lit(error).alias("identity_error"))
