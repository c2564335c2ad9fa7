"""An exact index over vectors: inverted lists around centroids, of which a query skips what can't be among its k most similar.

Each vector is in the list of its nearest centroid, and its angle to it is
kept. A query at an angle a from a centroid is at least |a - b| away from any
vector at an angle b from it, so the range of a list's angles bounds the
similarity of all its vectors. The lists with the highest bounds are searched
first, until they hold k vectors; the k-th best of them is what the bound of
another list has to reach. Within a list a matrix product screens all pairs,
and only pairs that could be among the k best are computed as similarity is
defined, term by term.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.operators.retrieval import top_k
from attestry.operators.sizes import broadcast_if_small

#: The sample that centroids are fitted on: rows, and bytes of them as doubles. Every vector is in the index.
SAMPLE_ROWS, SAMPLE_BYTES = 20_000, 64 << 20
MOST_LISTS, ROUNDS = 1024, 10
#: What rounding can make of a similarity of at most 1, many times over.
SLACK = 1e-9
#: Rows of a list, and queries, that meet in one task.
SLICE_ROWS, SLICE_QUERIES = 8192, 1024
#: Vectors that a matrix product takes at once.
AT_ONCE = 64
#: The list of vectors that have no angle: null or empty ones, of another length, of length 0, or not finite. It is always searched.
ODD = -1


def fit_centroids(vectors: DataFrame, lists: int | None = None, id_col: str = "chunk_id", col: str = "embedding", seed: int = 0) -> np.ndarray:
    """Unit centroids (lists x dimension) by k-means on directions; none where no vector has a direction.

    An action: the sample is the vectors with the smallest hashes of their
    ids, at most SAMPLE_ROWS, whatever the size of the table. Without a number
    of lists there are as many as the root of the number of vectors.
    """
    usable = vectors.where(_has_direction(F.col(col)))
    got = usable.agg(F.count("*").alias("n"), F.mode(F.size(col), True).alias("d")).first()
    if not got["n"]:
        return np.zeros((0, 0))
    d = got["d"]
    rows = min(SAMPLE_ROWS, max(1, SAMPLE_BYTES // (8 * d)))
    sample = usable.where(F.size(col) == d).orderBy(F.xxhash64(F.col(id_col).cast("string")), id_col).limit(rows).select(col).toPandas()[col]
    x = np.array(sample.tolist(), float)
    x /= np.linalg.norm(x, axis=1)[:, None]
    k = min(lists or math.isqrt(got["n"]), MOST_LISTS, len(x))
    centres = x[np.random.default_rng(seed).choice(len(x), max(1, k), replace=False)]
    for _ in range(ROUNDS):
        nearest = (x @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, x)
        size = np.linalg.norm(sums, axis=1)
        centres = np.where(size[:, None] > 1e-12, sums / np.maximum(size, 1e-12)[:, None], centres)
    return centres


def _has_direction(v: Column) -> Column:
    finite = F.forall(v, lambda c: F.coalesce(F.abs(c.cast("double")) < float("inf"), F.lit(False)))
    return F.coalesce(finite & F.exists(v, lambda c: c != 0), F.lit(False))


def _directions(vectors: pa.Array | pa.ChunkedArray, d: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Vectors of d entries, the same at length 1, and which rows have a direction; the others are zeros."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    fine = pc.fill_null(pc.equal(pc.list_value_length(vectors), d), False).to_numpy(zero_copy_only=False)
    wide = np.zeros((len(fine), d))
    if fine.any():  # a null reads as NaN
        wide[fine] = pc.list_flatten(vectors.filter(pa.array(fine))).cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, d)
    with np.errstate(all="ignore"):
        size = np.linalg.norm(wide, axis=1)
        fine &= (size > 0) & (size < np.inf)
        unit = wide / size[:, None]
    wide[~fine] = unit[~fine] = 0.0
    return wide, unit, fine


def _sliced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in parts: beside a vector stands a row of as many values as there are lists."""
    for b in batches:
        for i in range(0, b.num_rows, 4 * AT_ONCE):
            yield b.slice(i, 4 * AT_ONCE)


def indexed(vectors: DataFrame, centres: np.ndarray, col: str = "embedding") -> DataFrame:
    """Adds list and angle, to the list's centroid. Every row has a list; the table can be written and read again."""
    d = centres.shape[1]
    schema = T.StructType([*vectors.schema, T.StructField("list", T.IntegerType()), T.StructField("angle", T.DoubleType())])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            _, x, good = _directions(b.column(col), d)
            near = x @ centres.T if len(centres) else np.zeros((len(x), 1))
            at = near.argmax(1)
            angle = np.arccos(np.clip(near[np.arange(len(x)), at], -1, 1))
            added = [pa.array(np.where(good, at, ODD), pa.int32()), pa.array(np.where(good, angle, 0.0))]
            yield pa.RecordBatch.from_arrays([*b.columns, *added], names=schema.names)

    return vectors.mapInArrow(place, schema)


def list_bounds(queries: DataFrame, index: DataFrame, centres: np.ndarray, keys: list[str] = ()) -> DataFrame:
    """(query_id, embedding, norm, keys, list, n, bound): for each query the lists that hold vectors of its keys, with the most similarity that their angles allow."""
    d = centres.shape[1]

    asked = queries.select("query_id", "embedding", "norm", *keys)
    schema = T.StructType([*asked.schema, T.StructField("_angles", T.ArrayType(T.DoubleType()))])

    def angles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _sliced(batches):
            _, x, good = _directions(b.column("embedding"), d)
            got = np.arccos(np.clip(x @ centres.T, -1, 1))
            ends = pa.array(np.arange(len(x) + 1) * len(centres), pa.int32())
            rows = pa.ListArray.from_arrays(ends, pa.array(got.ravel()), mask=pa.array(~good))
            yield pa.RecordBatch.from_arrays([*b.columns, rows], names=schema.names)

    # At most one row for each list and key.
    lists = index.groupBy("list", *keys).agg(F.count("*").alias("n"), F.min("angle").alias("least"), F.max("angle").alias("most"))
    asked = asked.mapInArrow(angles, schema)
    both = asked.join(broadcast_if_small(lists), list(keys)) if keys else asked.join(F.broadcast(lists))  # without keys there are MOST_LISTS rows and one
    at = F.get("_angles", F.col("list"))
    apart = F.greatest(F.lit(0.0), at - F.col("most"), F.col("least") - at)
    bound = F.when((F.col("list") == ODD) | F.col("_angles").isNull(), 2.0).otherwise(F.cos(F.least(apart, F.lit(math.pi))))
    return both.select("query_id", "embedding", "norm", *keys, "list", "n", bound.alias("bound"))


def _search(pairs: DataFrame, index: DataFrame, k: int, keys: list[str]) -> DataFrame:
    """(query_id, sim, index columns but the vector and its norm): the k best of each query in each slice of a list, or fewer; pairs: list_bounds() with kth, null or what to reach.

    Lists and queries meet in slices of bounded size, so a list that holds
    most vectors is no hot task. Lists that no query asks for don't move.
    """
    place = ["list", *keys, "_slice", "_part"]
    slices = F.ceil(F.col("n") / SLICE_ROWS).cast("int")
    per_list = pairs.groupBy("list", *keys).agg(F.max(slices).alias("_slices"), F.ceil(F.count("*") / SLICE_QUERIES).cast("int").alias("_parts"))
    held = index.join(broadcast_if_small(per_list), ["list", *keys])
    held = held.withColumn("_slice", F.pmod(F.xxhash64("chunk_id"), F.col("_slices")).cast("int")).withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_slices", "_parts")
    asked = pairs.join(broadcast_if_small(per_list), ["list", *keys])
    asked = asked.withColumn("_part", F.pmod(F.xxhash64("query_id"), F.col("_parts")).cast("int")).withColumn("_slice", F.explode(F.sequence(F.lit(0), F.col("_slices") - 1)))
    asked = asked.select("query_id", F.col("embedding").alias("_qe"), F.col("norm").alias("_qn"), "kth", *(F.col(c).alias(f"_q{c}") for c in place))
    columns = [f for f in index.schema if f.name not in ("list", "angle", "embedding", "norm")]
    schema = T.StructType([pairs.schema["query_id"], T.StructField("sim", T.DoubleType()), *columns])

    def compare(ours: pa.Table, theirs: pa.Table) -> pa.Table:
        x, q = ours.column("embedding"), theirs.column("_qe")
        d = pc.max(pc.list_value_length(q)).as_py() or 1
        (wide, xu, xg), (asked, qu, qg) = _directions(x, d), _directions(q, d)
        norms, qn, kth = (t.column(c).cast(pa.float64()).fill_null(math.nan).to_numpy() for t, c in ((ours, "norm"), (theirs, "_qn"), (theirs, "kth")))
        place = np.empty(len(xg), np.int64)  # of the rows by chunk_id, which orders equal ones
        place[pc.sort_indices(ours, sort_keys=[("chunk_id", "ascending")], null_placement="at_start").to_numpy()] = np.arange(len(xg))
        n_good, odd = int(xg.sum()), {j: x[j].as_py() for j in np.flatnonzero(~xg).tolist()}
        rows, sims, none, asks = [], [], [], []
        for i in range(len(q)):
            if i % AT_ONCE == 0:
                products = qu[i : i + AT_ONCE] @ xu.T
            near = products[i % AT_ONCE]
            reach = -math.inf if math.isnan(kth[i]) else kth[i]
            if n_good >= k:
                reach = max(reach, np.partition(near if n_good == len(near) else near[xg], -k)[-k])
            some = np.flatnonzero(~xg | (near >= reach - SLACK)) if qg[i] else np.arange(len(xg))
            with np.errstate(all="ignore"):  # products are added one after the other, as in the definition
                below = norms[some] * qn[i]
                exact = np.add.accumulate(wide[some] * asked[i], axis=1)[:, -1] / below
            null = below == 0
            for at in np.flatnonzero(~xg[some]).tolist() if qg[i] else range(len(some)):
                j = int(some[at])
                plain = _plain(odd[j] if j in odd else x[j].as_py(), q[i].as_py(), float(norms[j]), float(qn[i]))
                null[at], exact[at] = plain is None, math.nan if plain is None else plain
            if len(some) > k:  # as top_k() orders: NaN, falling similarities, nulls
                best = np.lexsort((place[some], np.where(np.isnan(exact), 0.0, -exact), np.where(null, 2, ~np.isnan(exact))))[:k]
                some, exact, null = some[best], exact[best], null[best]
            rows.append(some)
            sims.append(exact)
            none.append(null)
            asks.append(np.full(len(some), i))
        rows, sims, none, asks = (np.concatenate(y) if y else np.zeros(0, t) for y, t in ((rows, np.int64), (sims, float), (none, bool), (asks, np.int64)))
        taken = ours.select([f.name for f in columns]).take(pa.array(rows, pa.int64()))
        return pa.Table.from_arrays([theirs.column("query_id").take(pa.array(asks, pa.int64())), pa.array(sims, pa.float64(), mask=none), *taken.columns], names=schema.names)

    on_left, on_right = held.groupBy(*place), asked.groupBy(*(f"_q{c}" for c in place))
    return on_left.cogroup(on_right).applyInArrow(compare, schema)


def _plain(x: list | None, q: list | None, norm: float, qn: float) -> float | None:
    """The similarity of vectors without an angle, as retrieval.similarities() has it: null with a null, of different lengths, or of length 0."""
    if x is None or q is None or len(x) != len(q) or any(v is None for v in (*x, *q)) or not norm * qn:
        return None
    total = 0.0
    for a, b in zip(x, q):
        total += a * b
    return total / (norm * qn)


def search(queries: DataFrame, index: DataFrame, centres: np.ndarray, k: int, keys: list[str] = ()) -> DataFrame:
    """(query_id, sim, index columns but the vector and its norm), among them each query's k most similar vectors that equal it in keys.

    queries: (query_id, embedding, norm, keys); index: indexed() of vectors
    with chunk_id, embedding and norm (retrieval.with_norm). Null keys equal
    nothing. Of each slice of a list the k best are kept, ties by chunk_id.
    """
    pairs = list_bounds(queries, index, centres, keys)
    falling = Window.partitionBy("query_id").orderBy(F.desc("bound"), "list")
    before = F.coalesce(F.sum(F.when(F.col("list") != ODD, F.col("n"))).over(falling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    pairs = pairs.withColumn("_first", (before < k) | (F.col("bound") > 1)).withColumn("kth", F.lit(None).cast("double"))
    first = _search(pairs.where("_first").drop("_first", "bound"), index, k, keys)
    best = top_k(first.select("query_id", "sim", "chunk_id"), k)
    kth = best.where(F.col("sim").isNotNull()).groupBy("query_id").agg(F.count("*").alias("found"), F.min("sim").alias("kth"))
    kth = kth.select("query_id", F.when((F.col("found") >= k) & ~F.isnan("kth"), F.col("kth")).alias("kth"))
    rest = pairs.where(~F.col("_first")).drop("kth", "_first").join(kth, "query_id", "left")
    rest = rest.where(F.col("kth").isNull() | (F.col("bound") >= F.col("kth") - SLACK)).drop("bound")
    return first.unionByName(_search(rest, index, k, keys))


def index_top_k(queries: DataFrame, vectors: DataFrame, k: int, keys: list[str] = (), lists: int | None = None) -> DataFrame:
    """retrieval.top_k() of retrieval.similarities(), by an index that is fitted for it."""
    centres = fit_centroids(vectors, lists)
    return top_k(search(queries, indexed(vectors, centres), centres, k, keys), k)


def nearest(queries: DataFrame, vectors: DataFrame, k: int, keys: list[str] = ()) -> DataFrame:
    """retrieval.top_k() of retrieval.similarities() without the vectors and norms, from all pairs but slice by slice.

    All vectors of a key are one list. A task holds one slice of vectors and
    of queries and passes on k rows for each query, so pairs are never rows.
    """
    whole = vectors.withColumns({"list": F.lit(0), "angle": F.lit(0.0)})
    n = whole.groupBy("list", *keys).agg(F.count("*").alias("n"))
    asked = queries.select("query_id", "embedding", "norm", *keys)
    pairs = asked.join(broadcast_if_small(n), list(keys)) if keys else asked.join(F.broadcast(n))  # without keys it is one row
    return top_k(_search(pairs.withColumn("kth", F.lit(None).cast("double")), whole, k, keys), k)
