"""Whitening of embeddings by a covariance of two passes.

The first pass adds up the different vectors, as integers and so exactly,
which gives their mean. The second subtracts it and adds up outer products, a
matrix product for each batch. Sums of partitions meet in a tree. The
covariance, which is as large as the square of the dimension, is decomposed on
the driver, and the projection goes to all rows. A third pass measures how far
the whitened vectors' covariance is from the identity.
"""

from __future__ import annotations

import io
from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import Batches, mapped, stage, unstage

#: An entry c is the integer floor(STEP * c) + OFFSET.
STEP, OFFSET = 64, 1_000_000
#: Integers beyond this are not exact as doubles; entries that would need one count as not finite.
LARGEST = 1 << 52
#: A component with less than this share of the variance has none: what is left of it is rounding.
NO_VARIANCE = 1e-12


@dataclass
class Whitening:
    """What is fitted: all vectors are of integers less the offset."""

    n: int
    sums: list[int]
    components: np.ndarray  # dimension x k, unit vectors
    eigenvalues: np.ndarray  # k, falling
    trace: float
    identity_error: float

    @property
    def mean(self) -> np.ndarray:
        """The mean's whole part, and what is left of it: both exact, or to the last digit."""
        whole = [s // self.n for s in self.sums]
        return np.array([whole, [(s - w * self.n) / self.n for s, w in zip(self.sums, whole)]])

    @property
    def projection(self) -> np.ndarray:
        """Components over the root of their variance; those without any are 0."""
        some = self.eigenvalues > NO_VARIANCE * self.trace
        return np.where(some, self.components / np.sqrt(np.where(some, self.eigenvalues, 1.0)), 0.0)


def integers(vector: Column) -> Column:
    """The integers of a vector's entries without the offset; null unless all entries are finite and in range, or without entries."""
    x = F.transform(vector, lambda c: F.floor(c.cast("double") * STEP))
    # A comparison with NaN holds where it is the larger one, with null it is null.
    fine = F.forall(vector, lambda c: F.coalesce(F.abs(c.cast("double")) * STEP < LARGEST, F.lit(False)))
    return F.when(fine & (F.size(vector) > 0), x)


def _matrix(x: pa.Array, d: int) -> np.ndarray:
    x = x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x
    return x.flatten().to_numpy(zero_copy_only=False).reshape(-1, d)


def _packed(a: np.ndarray) -> bytes:
    out = io.BytesIO()
    np.save(out, a, allow_pickle=False)
    return out.getvalue()


def _read(data: bytes) -> np.ndarray:
    return np.load(io.BytesIO(bytes(data)), allow_pickle=False)


def _added(vectors: DataFrame, col: str, d: int, of_batch: Callable[[np.ndarray], np.ndarray]) -> np.ndarray | float:
    """The sum of of_batch over all batches: one array a partition, which meet in a tree."""

    def run(batches: Batches) -> Batches:
        total = None
        for b in batches:
            part = of_batch(_matrix(b.column(col), d))
            total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([_packed(total)], pa.binary())], names=["part"])

    parts = mapped(vectors.select(col), run, "part binary").rdd.map(lambda r: _read(r[0]))
    add = lambda a, b: a + b
    return parts.treeAggregate(0.0, add, add, depth=2)


#: Integers are added in halves of so many bits. Up to 2^53 rows of either fit into 63 bits.
HALF = 26


def halves(x: np.ndarray) -> np.ndarray:
    """The number of rows, and the column sums of the higher and lower halves of the integers: added up in 64 bits without loss."""
    return np.stack([np.full(x.shape[1], len(x)), (x >> HALF).sum(0), (x & (1 << HALF) - 1).sum(0)])


def fit(vectors: DataFrame, col: str, d: int, k: int) -> Whitening | None:
    """The whitening of the different vectors (array<bigint> of d entries); None without any.

    vectors is read three times, so it should be a written table. What leaves
    a partition is 3 times d integers, or d times d doubles.
    """
    added = _added(vectors, col, d, halves)
    if np.isscalar(added):
        return None
    n = int(added[0][0])
    found = Whitening(n, [(int(h) << HALF) + int(low) for h, low in zip(added[1], added[2])], np.zeros((d, k)), np.zeros(k), 0.0, 0.0)
    whole, left = found.mean
    base = whole.astype(np.int64)

    def outer(x: np.ndarray) -> np.ndarray:
        y = (x - base).astype(float) - left
        return y.T @ y

    covariance = _added(vectors, col, d, outer) / n
    values, components = np.linalg.eigh(covariance)
    found.trace = float(np.trace(covariance))
    found.eigenvalues, found.components = np.maximum(values[::-1][:k], 0.0), components[:, ::-1][:, :k]
    projection = found.projection

    def checked(x: np.ndarray) -> np.ndarray:
        z = ((x - base).astype(float) - left) @ projection
        return np.concatenate([z.sum(0)[None, :], z.T @ z])

    measured = _added(vectors, col, d, checked)
    mean = measured[0] / n
    has = np.diag((found.eigenvalues > NO_VARIANCE * found.trace).astype(float))
    found.identity_error = float(np.abs(measured[1:] / n - np.outer(mean, mean) - has).max())
    return found


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """For each row the sum of (n * x - S)^2, exact; None if it is beyond 64 bits."""
    base = [s // n for s in sums]
    rest = np.array([s - b * n for s, b in zip(sums, base)])  # less than n
    far = int(np.abs(x - np.array(base)).max(initial=0)) + 1
    if (far * n) ** 2 * x.shape[1] < 1 << 63:
        off = (x - np.array(base)) * n - rest
        return (off * off).sum(1).tolist()
    exact = [sum((n * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in x.tolist()]
    return [v if v < 1 << 63 else None for v in exact]


def whiten(rows: DataFrame, components: int = 16, vector_col: str = "embedding", id_col: str = "vec_id") -> DataFrame:
    """Per row and component: id, component, n, deviation, whitened, explained, identity_error.

    Rows go whose vector is null or empty or has an entry that is null, not
    finite, or too large for an exact integer. So do rows whose vector is not
    as long as most (the smaller length, if two are the commonest). Vectors
    that repeat count once in the fit; each row has its results. Components
    are at most as many as the vectors are long; one without variance (a fit
    of one vector, or of fewer than components) is whitened to 0 and explains
    0. A deviation beyond 64 bits is null. No rows give no rows. Other columns
    are not read.
    """
    schema = T.StructType(
        [
            rows.schema[id_col], T.StructField("component", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("deviation", T.LongType()),
            T.StructField("whitened", T.DoubleType()), T.StructField("explained", T.DoubleType()), T.StructField("identity_error", T.DoubleType()),
        ]
    )
    kept = stage(rows.select(F.col(id_col).alias("id"), integers(F.col(vector_col)).alias("x")).where("x IS NOT NULL"), "whitening-rows")
    lengths = kept.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), "d").first()
    d = lengths["d"] if lengths else 1
    alike = kept.where(F.size("x") == d)
    # Copies go before the exchange; hot vectors are one row of each task.
    distinct = stage(alike.select("x").distinct(), "whitening-fit")
    k = min(components, d)
    found = fit(distinct, "x", d, k)
    unstage(distinct)
    if found is None:
        return rows.sparkSession.createDataFrame([], schema)
    whole, left = found.mean
    base, projection = whole.astype(np.int64), found.projection
    share = np.where(found.eigenvalues > NO_VARIANCE * found.trace, found.eigenvalues / (found.trace or 1.0), 0.0)
    number, n, total, error = np.arange(1, k + 1, dtype=np.int32), found.n, found.sums, found.identity_error

    def project(batches: Batches) -> Batches:
        for b in batches:
            x = _matrix(b.column("x"), d)
            rows_of, m = pa.array(np.repeat(np.arange(len(x)), k)), len(x)
            z = ((x - base).astype(float) - left) @ projection
            deviation = pa.array(deviations(x, n, total), pa.int64()).take(rows_of)
            constant = lambda v, t: pa.array(np.full(m * k, v, t))
            columns = [b.column("id").take(rows_of), pa.array(np.tile(number, m)), constant(n, np.int64), deviation, pa.array(z.ravel()), pa.array(np.tile(share, m)), constant(error, float)]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return mapped(alike, project, schema)
