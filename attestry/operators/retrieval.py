"""Retrieval of legal chunks over given vectors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.operators.sizes import broadcast_if_small


def dot(a: Column, b: Column) -> Column:
    """The sum of products in the order of the elements, in doubles."""
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda acc, x: acc + x)


def with_norm(vectors: DataFrame, col: str = "embedding") -> DataFrame:
    """Adds norm, so that a similarity join computes one product for each pair."""
    return vectors.withColumn("norm", F.sqrt(dot(F.col(col), F.col(col))))


def similarities(queries: DataFrame, chunks: DataFrame, keys: list[str] = ()) -> DataFrame:
    """(query_id, chunk_id, sim, chunk columns) of chunks that equal the query in keys.

    A stated set of queries against all chunks, which are sent to them if they
    are small, counted: then a key that most chunks have is no hot spot.
    Otherwise it is an exchange by key, or without keys block by block.
    """
    q = queries.select(F.col("query_id"), F.col("embedding").alias("_qe"), F.col("norm").alias("_qn"), *(F.col(k).alias(f"_q_{k}") for k in keys))
    on = [F.col(k) == F.col(f"_q_{k}") for k in keys]
    q = broadcast_if_small(q, 8 * F.size("_qe") + 64)
    both = chunks.join(q, on, "inner") if keys else chunks.crossJoin(q)
    return both.withColumn("sim", F.try_divide(dot(F.col("embedding"), F.col("_qe")), F.col("norm") * F.col("_qn"))).drop("_qe", "_qn", *(f"_q_{k}" for k in keys))


def top_k(sims: DataFrame, k: int, tie: str = "chunk_id", per: str = "query_id") -> DataFrame:
    """The k most similar chunks for each query, with their rank."""
    w = Window.partitionBy(per).orderBy(F.desc("sim"), F.col(tie))
    return sims.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def with_fallback(filtered: DataFrame, unfiltered: DataFrame, per: str = "query_id") -> DataFrame:
    """The filtered results, and for queries without any the unfiltered ones."""
    return filtered.withColumn("filtered", F.lit(True)).unionByName(unfiltered.join(filtered.select(per).distinct(), per, "left_anti").withColumn("filtered", F.lit(False)))


def anchors(references: DataFrame, chunks: DataFrame, keys: list[str], most: int = 2, order: str = "chunk_id") -> DataFrame:
    """The chunks that a query names by key, at most `most` for each reference.

    No reference takes more than the first of its key, so the others are left out before the join.
    """
    of_key = Window.partitionBy(*keys).orderBy(order)
    first = chunks.withColumn("_n", F.row_number().over(of_key)).where(F.col("_n") <= most).drop("_n")
    got = references.join(first, keys)
    w = Window.partitionBy("query_id", *keys).orderBy(order)
    return got.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def merged(anchor: DataFrame, semantic: DataFrame, dedupe: list[str], k: int) -> DataFrame:
    """Anchors, then semantic results; the first of equal ones; at most max(k, number of anchors).

    Both have query_id, pos and the dedupe columns.
    """
    every = anchor.withColumn("src", F.lit(0)).unionByName(semantic.withColumn("src", F.lit(1)), allowMissingColumns=True)
    first = every.withColumn("_r", F.row_number().over(Window.partitionBy("query_id", *dedupe).orderBy("src", "pos"))).where("_r = 1").drop("_r")
    n = F.coalesce(F.sum(F.when(F.col("src") == 0, 1).otherwise(0)).over(Window.partitionBy("query_id")), F.lit(0))
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("src", "pos"))).withColumn("_anchors", n)
    return ranked.where(F.col("rank") <= F.greatest(F.lit(k), F.col("_anchors"))).drop("_anchors")


#: What a query without a chunk is told.
NO_LAW = "(no provision was retrieved)"


def render(chunks: DataFrame, order: str = "rank", queries: DataFrame | None = None) -> DataFrame:
    """(query_id, context): the chunks as one text, in order. With queries, those without a chunk have the notice."""
    line = F.concat(F.lit("["), F.col("regulation"), F.lit(" — Article "), F.col("article"), F.lit("]\n"), F.col("text"))
    lines = F.transform(F.sort_array(F.collect_list(F.struct(F.col(order).alias("o"), line.alias("line")))), lambda x: x["line"])
    out = chunks.groupBy("query_id").agg(F.array_join(lines, "\n\n").alias("context"))
    if queries is None:
        return out
    return queries.select("query_id").distinct().join(out, "query_id", "left").withColumn("context", F.coalesce("context", F.lit(NO_LAW)))
