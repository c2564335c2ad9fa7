"""Ranked lexical search: the k highest-scoring documents for each item, by a threshold-seeded join.

For each term the k-th highest impact that a document has by it alone is
stored. k documents score at least that, so the best of an item's terms bounds
its k-th score from below. Terms are ordered by their highest impact; the last
of them, which together can't reach the bound, name no candidates. Documents
that hold one of the others are candidates, and what they have by these terms
raises the bound. Candidates that could reach it with the rest are scored
exactly. All arithmetic on scores is in 64-bit integers.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import BROADCAST_BYTES, Batches, broadcast_if_small, mapped, stage, texts_of, unstage

#: Lower-cases A-Z and makes a space of every ASCII character that is no letter or digit. Bytes of other characters stay.
FOLDED = bytes(b if b >= 0x80 or chr(b).isalnum() else 0x20 for b in range(256)).translate(bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz"))


def terms_of(text: str) -> list[bytes]:
    """A text's terms as UTF-8, in order and with repeats."""
    return text.encode().translate(FOLDED).split()


def counted(rows: DataFrame, text_col: str, keep: list[str], only: set[bytes] | None = None) -> DataFrame:
    """Each row's kept columns with n (its terms, with repeats), terms (array<string>, each once) and tfs (array<int>, how often).

    With `only`, terms and tfs are of those terms; n counts all.
    """
    lists = [T.StructField("terms", T.ArrayType(T.StringType())), T.StructField("tfs", T.ArrayType(T.IntegerType()))]
    schema = T.StructType([*(rows.schema[c] for c in keep), T.StructField("n", T.LongType()), *lists])
    sent = None if only is None else rows.sparkSession.sparkContext.broadcast(only)

    def run(batches: Batches) -> Batches:
        wanted = sent and sent.value
        for b in batches:
            n, size, terms, tfs = [], [0], [], []
            for t in texts_of(b, text_col):
                words = terms_of(t)
                count = Counter(words if wanted is None else [w for w in words if w in wanted])
                n.append(len(words))
                terms += count.keys()
                tfs += count.values()
                size.append(len(terms))
            offsets = pa.array(size, pa.int32())
            columns = [pa.ListArray.from_arrays(offsets, pa.array(terms, pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(offsets, pa.array(np.array(tfs, np.int32)))]
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(n, pa.int64()), *columns], names=schema.names)

    return mapped(rows.select(*keep, F.col(text_col).cast("string").alias(text_col)), run, schema)


def _postings(index: DataFrame, *keep: str) -> DataFrame:
    """One row for each document and term."""
    pair = F.explode(F.arrays_zip("terms", "tfs")).alias("p")
    return index.select(*keep, pair).select(*keep, F.col("p.terms").alias("term"), F.col("p.tfs").cast("bigint").alias("tf"))


def _length_factor(documents: int, terms: int) -> Column:
    """m: how a document's length weighs."""
    return F.lit(75) + F.expr(f"(25 * n * {documents}L) div {max(terms, 1)}L")


def _impact() -> Column:
    """What one occurrence of a term in an item gives a document with tf and m."""
    return F.expr("w * ((1000000000L * tf) div (1000L * tf + 12 * m))")


def term_bounds(index: DataFrame, wanted: DataFrame, documents: int, terms: int, k: int) -> DataFrame:
    """(term, w, most, kth): a term's weight, its highest impact and its k-th highest one, 0 if fewer documents hold it.

    Impacts depend on tf and m only, so documents are counted by them where
    they are, and few rows of a term meet.
    """
    posted = _postings(index, "n").withColumn("m", _length_factor(documents, terms))
    alike = posted.join(wanted, "term", "left_semi").groupBy("term", "tf", "m").agg(F.count("*").alias("docs"))
    held = Window.partitionBy("term")
    weight = F.floor(F.lit(1000.0) * F.log(F.lit(2.0 * documents + 2.0) / (F.lit(2.0) * F.sum("docs").over(held) + F.lit(1.0))))
    impacts = alike.withColumn("w", weight).withColumn("impact", _impact())
    so_far = F.sum("docs").over(held.orderBy(F.desc("impact")))
    kth = F.coalesce(F.max(F.when(F.col("so_far") >= k, F.col("impact"))), F.lit(0))
    return impacts.withColumn("so_far", so_far).groupBy("term", "w").agg(F.max("impact").alias("most"), kth.alias("kth"))


def pruned(item_terms: DataFrame, bounds: DataFrame) -> DataFrame:
    """(item, term, q, w, bound, rest, names): each item's terms that can give a score.

    bound: the item's k-th score is no less. names: whether the term names
    candidates. rest: what the item's other terms can give at most.
    """
    scoring = item_terms.join(bounds, "term").where("most > 0").withColumn("most", F.col("q") * F.col("most"))
    of_item = Window.partitionBy("item")
    # From the end of the falling order: what a term and those after it can give together.
    suffix = F.sum("most").over(of_item.orderBy("most", F.desc("term")).rowsBetween(Window.unboundedPreceding, 0))
    bound = F.max(F.col("q") * F.col("kth")).over(of_item)
    out = scoring.select("item", "term", "q", "w", bound.alias("bound"), suffix.alias("suffix"))
    names = F.col("suffix") >= F.col("bound")
    rest = F.coalesce(F.max(F.when(~names, F.col("suffix"))).over(of_item), F.lit(0))
    return out.select("item", "term", "q", "w", "bound", rest.alias("rest"), names.alias("names"))


def ranked(docs: DataFrame, items: DataFrame, k: int = 20, text_col: str = "text", id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """(item, rank, id, score): each item's k highest-scoring documents with a score above 0, equal scores by ascending id.

    Each row of docs is a document, also if its id repeats; null ids come last
    among equals. Null and empty texts hold no term. Rows of items that repeat
    an id are one item with the terms of its different texts; items without an
    id are left out. Items without terms, or whose terms are in no document,
    have no rows. Other columns are not read, so none clashes.

    Terms of all items go to the tasks if they add up to BROADCAST_BYTES at
    most; beyond it documents keep all their terms and joins go by exchange.
    """
    item_field, id_field = items.schema[item_col], docs.schema[id_col]
    asked = items.where(F.col(item_col).isNotNull()).select(F.col(item_col).alias("item"), F.col(text_col).alias("_text")).distinct()
    posted = counted(asked, "_text", ["item"])
    item_terms = stage(_postings(posted, "item").groupBy("item", "term").agg(F.sum("tf").alias("q")), "ranking-items")
    wanted = stage(item_terms.select("term").distinct(), "ranking-terms")
    room = wanted.agg(F.sum(F.octet_length("term") + 64)).first()[0] or 0
    only = {r[0].encode() for r in wanted.toLocalIterator()} if room <= BROADCAST_BYTES else None

    numbered = docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    index = stage(counted(numbered, "_text", ["row", "id"], only), "ranking-index")
    documents, terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    wanted = broadcast_if_small(wanted, F.octet_length("term") + 64)
    bounds = term_bounds(index, wanted, documents, terms, k)
    plan = stage(pruned(item_terms, bounds), "ranking-plan")
    m = _length_factor(documents, terms)

    def with_items(rows: DataFrame, on: list[str], part: DataFrame) -> DataFrame:
        small = broadcast_if_small(part, F.octet_length("term") + 64)
        return rows.join(small, on).withColumn("part", F.col("q") * _impact())

    naming = with_items(_postings(index, "row", "n").withColumn("m", m), ["term"], plan.where("names"))
    sums = naming.groupBy("item", "row").agg(F.sum("part").alias("sure"), F.first("bound").alias("bound"), F.first("rest").alias("rest"))
    candidates = stage(sums.where("sure + rest >= bound"), "ranking-candidates")
    best = Window.partitionBy("item").orderBy(F.desc("sure"))
    first_k = candidates.select("item", "sure", F.row_number().over(best).alias("place")).where(F.col("place") <= k)
    # Where k candidates are sure of so much, the k-th score is no less.
    raised = first_k.groupBy("item").agg(F.min("sure").alias("least"), F.count("*").alias("found"))
    raised = raised.select("item", F.when(F.col("found") == k, F.col("least")).otherwise(0).alias("raised"))
    likely = stage(candidates.join(broadcast_if_small(stage(raised, "ranking-bounds")), "item").where("sure + rest >= raised").select("item", "row"), "ranking-likely")

    rows = index.join(broadcast_if_small(likely), "row")
    exact = with_items(_postings(rows, "item", "row", "id", "n").withColumn("m", m), ["item", "term"], plan)
    scores = exact.groupBy("item", "row", "id").agg(F.sum("part").alias("score")).where("score > 0")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.asc_nulls_last("id"), "row")
    out = scores.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    unstage(candidates)
    return out.select(F.col("item").alias(item_field.name), "rank", F.col("id").alias(id_field.name), "score")
