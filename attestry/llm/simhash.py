"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most 2r bits have a value between them that
differs from either in at most r. So each different fingerprint emits all
values within r bits of it, and fingerprints meet at equal values. For r = 1
these are 65 values whatever the data, and at most 65 fingerprints can meet at
a value, so no group grows with the corpus. All that meet at a value are
within 2r bits of each other; linking each to the smallest of them (verified
by counting the bits) therefore keeps exactly the components of all links,
without a pair for every two.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm import minhash
from attestry.llm.common import Batches, broadcast_if_small, free_name, mapped, stage, text_column, texts_of, unstage
from attestry.llm.components import components
from attestry.llm.shingles import tokens_of

SEED = 42
SHINGLE = 3
RADIUS = 2
#: Variants that one task emits.
BALLS_A_TASK = 4_000_000
#: Shingles whose bits are counted at once.
AT_ONCE = 1 << 14


def shingle_hashes(text: str, k: int = SHINGLE) -> np.ndarray:
    """XXH64 of each run of k words, repeats included; of all words if there are fewer.

    bytes.lower() changes A-Z only, and bytes.split() parts at the six ASCII
    white-space characters only.
    """
    words = text.encode().lower().split()
    if len(words) <= k:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), SEED)] if words else [], np.uint64)
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: 1 - k].tolist()
    digest = xxhash.xxh64_intdigest
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends[k - 1 :].tolist())], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), AT_ONCE):
        part = hashes[at : at + AT_ONCE]
        ones += np.unpackbits(part.astype("<u8").view(np.uint8).reshape(len(part), 8), axis=1, bitorder="little").sum(0, dtype=np.int32)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and fingerprint (as a signed 64-bit integer) of each whole text; null and empty texts have 0."""
    schema = T.StructType([docs.schema[id_col], T.StructField("fp", T.LongType())])

    def run(batches: Batches) -> Batches:
        for b in batches:
            fp = np.array([fingerprint(shingle_hashes(t)) for t in texts_of(b, text_col)], np.uint64)
            yield pa.RecordBatch.from_arrays([b.column(id_col), pa.array(fp.view(np.int64))], names=[id_col, "fp"])

    return mapped(docs.select(id_col, text_col), run, schema)


def links(fps: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Links (a, b) between different fingerprints, enough to connect all within the radius.

    fps has one row for each different fingerprint. The radius is even: all
    fingerprints that meet then are within it.
    """
    if radius % 2 or not 0 < radius <= 6:
        raise ValueError("the radius must be 2, 4 or 6")
    masks = [sum(1 << i for i in bits) for n in range(radius // 2 + 1) for bits in combinations(range(64), n)]
    signed = np.array(masks, np.uint64).view(np.int64).tolist()
    # One row becomes many, so the rows are dealt to as many tasks as their balls are worth.
    tasks = max(fps.sparkSession.sparkContext.defaultParallelism, fps.count() * len(masks) // BALLS_A_TASK + 1)
    balls = fps.repartition(tasks, "fp").select("fp", F.explode(F.array(*map(F.lit, signed)).cast("array<bigint>")).alias("mask")).select("fp", F.col("fp").bitwiseXOR(F.col("mask")).alias("variant"))
    met = balls.select("fp", F.min("fp").over(Window.partitionBy("variant")).alias("least"))
    return met.where((F.col("fp") != F.col("least")) & (F.bit_count(F.col("fp").bitwiseXOR(F.col("least"))) <= radius)).select(F.col("fp").alias("a"), F.col("least").alias("b")).distinct()


def near_duplicates(docs: DataFrame, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Per row: id, fp and component_id, the smallest id reachable by links.

    Rows with null, empty or equal texts share a fingerprint and so a
    component; repeated rows each keep a row. Rows without an id take part and
    have the smallest id of their component, null if there is none. An empty
    table gives an empty table; other columns are not read.
    """
    fps = stage(fingerprints(docs, text_col, id_col), "simhash-fp")
    # Equal fingerprints are one class before anything else, so that copies,
    # however many, count once.
    classes = stage(fps.groupBy("fp").agg(F.min(id_col).alias("least_id")), "simhash-classes")
    roots = components(links(classes.select("fp"), radius))
    rooted = classes.join(roots, classes["fp"] == roots["node"], "left").select("fp", "least_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    of_class = rooted.join(smallest, "root").select(F.col("fp").alias("class_fp"), "component_id")
    return fps.join(of_class, F.col("fp") == F.col("class_fp")).select(id_col, "fp", "component_id")


#: What the comparison of whole documents takes: words of a shingle, and how alike their sets are at least.
COMPARED_SHINGLE, COMPARED_SIMILARITY = 5, 0.8


def similar_documents(docs: DataFrame, shingle: int = COMPARED_SHINGLE, similarity: float = COMPARED_SIMILARITY, radius: int = RADIUS, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """id and component_id (the smallest id reachable) of each id, by links between documents whose sets of shingles are that similar.

    Documents with equal sets are one class. Classes are compared where the
    balls of their fingerprints collide, and where they agree in a band of
    min-hashes: the fingerprints of two documents with a similarity of 0.8
    differ in 10 of 64 bits on average, and a ball that reaches half as far
    has 8 million variants. All pairs are verified on the sets. In a band, a
    class is compared with the smallest of those that agree.

    Null and empty texts have equal (empty) sets; a text of fewer words has
    one shingle of them all. Rows that repeat an id are
    one document, rows without an id have no row. Very long texts count whole;
    an empty table gives an empty table; other columns are not read.
    """
    texts = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), text_column(docs, text_col).alias("text"))

    def keys(batches: Batches) -> Batches:
        for b in batches:
            tokens, ends = tokens_of(texts_of(b), shingle, whole=True)
            hashes = [tokens[s:e] for s, e in zip(ends, ends[1:])]
            fp = np.array([fingerprint(h) for h in hashes], np.uint64)
            sets = [np.unique(h) for h in hashes]
            with np.errstate(over="ignore"):
                whole = np.array([[x.sum(dtype=np.uint64), np.bitwise_xor.reduce(x * x) if len(x) else 0] for x in sets], np.uint64).reshape(-1, 2).view(np.int64)
            bands = [minhash.bands(x) for x in sets]
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array(fp.view(np.int64)), pa.array(whole[:, 0]), pa.array(whole[:, 1]), pa.array(bands, pa.list_(pa.int64()))], names=["id", "fp", "w1", "w2", "bands"])

    def packed(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column("id"), pa.array([zlib.compress(x.encode(), 1) for x in texts_of(b)], pa.binary())], names=["id", "text"])

    def verify(batches: Batches) -> Batches:
        for b in batches:
            pairs = list(zip(b.column("a").to_pylist(), b.column("b").to_pylist()))
            held = dict(zip((i for i, _ in pairs), b.column("text").to_pylist())) | dict(zip((j for _, j in pairs), b.column("other").to_pylist()))
            tokens, ends = tokens_of([zlib.decompress(x).decode() for x in held.values()], shingle, whole=True)
            sets = {i: np.unique(tokens[s:e]) for i, s, e in zip(held, ends, ends[1:])}
            good = pa.array([minhash.similar(sets[i], sets[j], similarity) for i, j in pairs], pa.bool_())
            yield pa.RecordBatch.from_arrays([b.column(c).filter(good) for c in ("a", "b")], names=["a", "b"])

    signed = stage(mapped(texts, keys, "id bigint, fp bigint, w1 bigint, w2 bigint, bands array<bigint>"), "similar-keys")
    # Equal sets of shingles are one class before anything else, so that copies, however many, count once.
    classes = stage(signed.groupBy("w1", "w2").agg(F.min("id").alias("class_id"), F.min("bands").alias("bands"), F.min("fp").alias("fp")), "similar-classes")
    in_band = classes.select("class_id", F.explode("bands").alias("band"))
    least = in_band.groupBy("band").agg(F.min("class_id").alias("b"), F.max("class_id").alias("most")).where(F.col("b") < F.col("most")).select("band", "b")
    by_band = in_band.join(least, "band").where(F.col("class_id") != F.col("b")).select(F.col("class_id").alias("a"), "b")
    # Classes of one fingerprint are compared with the smallest of them, and these where balls collide.
    of_fp = classes.groupBy("fp").agg(F.min("class_id").alias("b"))
    same = classes.join(of_fp, "fp").where(F.col("class_id") != F.col("b")).select(F.col("class_id").alias("a"), "b")
    smallest = stage(of_fp, "similar-fingerprints")
    near = links(smallest.select("fp"), radius)
    of = lambda c: smallest.select(F.col("fp").alias(c), F.col("b").alias(f"id_{c}"))
    collided = near.join(of("a"), "a").join(of("b"), "b").select(F.greatest("id_a", "id_b").alias("a"), F.least("id_a", "id_b").alias("b"))
    pairs = stage(by_band.unionByName(same).unionByName(collided).distinct(), "similar-pairs")
    needed = stage(pairs.select(F.col("a").alias("needed_id")).union(pairs.select("b")).distinct(), "similar-ids")
    held = mapped(texts.join(broadcast_if_small(needed), F.col("id") == F.col("needed_id"), "left_semi").select("id", "text"), packed, "id bigint, text binary")
    held = stage(held.groupBy("id").agg(F.max("text").alias("text")), "similar-texts")  # rows that repeat an id are one document
    both = pairs.join(held.select(F.col("id").alias("a"), "text"), "a").join(held.select(F.col("id").alias("b"), F.col("text").alias("other")), "b")
    verified = stage(mapped(both.select("a", "b", "text", "other"), verify, "a bigint, b bigint"), "similar-links")
    unstage(needed, held, pairs, smallest)
    roots = components(verified)
    return signed.join(classes.select("w1", "w2", "class_id"), ["w1", "w2"]).join(roots, F.col("class_id") == F.col("node"), "left").groupBy("id").agg(F.min(F.coalesce("root", "class_id")).alias("component_id"))


def keep_one(docs: DataFrame, shingle: int = COMPARED_SHINGLE, similarity: float = COMPARED_SIMILARITY, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """The documents without near-duplicates: of each component of similar_documents() the one with the smallest id stays.

    Rows that repeat an id are one document, of which one row stays. Rows
    without an id can't be told apart and all stay. Columns are those of docs,
    whatever their names. An empty table gives an empty table.
    """
    found = similar_documents(docs, shingle, similarity, text_col=text_col, id_col=id_col)
    drop_id = free_name(docs, "drop_id")
    drop = stage(found.where(F.col("id") != F.col("component_id")).select(F.col("id").alias(drop_id)), "similar-drop")
    kept = docs.join(broadcast_if_small(drop), F.col(id_col) == F.col(drop_id), "left_anti").select(*docs.columns)
    if docs.where(F.col(id_col).isNotNull()).groupBy(id_col).count().where("count > 1").isEmpty():
        return kept
    return kept.where(F.col(id_col).isNull()).unionByName(kept.where(F.col(id_col).isNotNull()).dropDuplicates([id_col]))
