"""Document fingerprints by consistent weighted sampling, in DataFrame functions only.

A text is its lower-cased words (what stands between ASCII white space) with
their counts as weights; a text without a word has the empty word. For each of the fingerprint's
samples, a term draws r and c from Gamma(2, 1) and b from [0, 1), all from a
hash of the term and the sample's number. With

    t = floor(ln(weight) / r + b)        y = exp(r (t - b))        a = c / (y exp(r))

the term of the smallest a, together with its t, is the sample. Two texts have
the same sample with a probability equal to their generalised Jaccard
similarity, sum of min(weights) / sum of max(weights).

The draws come from tables of the distributions' quantiles, and the smallest a
is found as the smallest 64-bit integer, whose high half orders by ln a and
whose low half names the sample. So all is fixed-width arithmetic in generated
code, and terms are added up in place: the one exchange of texts is the one
that brings documents next to their neighbours.
"""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.llm.common import stage

#: Samples in a fingerprint, a multiple of BLOCK.
SAMPLES = 40
#: Samples that one row of a term draws. More would make the generated method
#: longer than what the JVM compiles.
BLOCK = 8
#: Quantiles in a table; its index is BITS bits of the hash.
BITS = 12
#: Bytes of text in a slot of neighbours, which one task lines up.
SLOT_BYTES = 16 << 20
#: ln a is between -LN_SHIFT and LN_SHIFT for weights below 10**12.
LN_SHIFT = 64
LN_SCALE = 1 << 24


@lru_cache(maxsize=1)
def gamma_quantiles() -> np.ndarray:
    """The mid-points of 2**BITS equal shares of Gamma(2, 1), by bisection of its distribution function 1 - (1 + x) exp(-x)."""
    share = (np.arange(1 << BITS) + 0.5) / (1 << BITS)
    low, high = np.zeros(1 << BITS), np.full(1 << BITS, 64.0)
    for _ in range(80):
        mid = (low + high) / 2
        over = 1 - (1 + mid) * np.exp(-mid) > share
        high, low = np.where(over, mid, high), np.where(over, low, mid)
    return (low + high) / 2


def _table(values: np.ndarray) -> Column:
    """An array literal: a constant that the optimiser folds once."""
    return F.split(F.lit(",".join(f"{v:.9g}" for v in values)), ",").cast("array<double>")


def sample(term: Column, ln_weight: Column, k: Column) -> Column:
    """The 64-bit integer whose minimum over a text's terms is sample k."""
    h = F.xxhash64(term, k)
    mask = (1 << BITS) - 1
    at = h.bitwiseAND(F.lit(mask)).cast("int")
    r = F.get(_table(gamma_quantiles()), at)
    ln_c = F.get(_table(np.log(gamma_quantiles())), F.shiftright(h, BITS).bitwiseAND(F.lit(mask)).cast("int"))
    b = F.shiftrightunsigned(h, 2 * BITS).cast("double") / F.lit(float(1 << (64 - 2 * BITS)))
    t = F.floor(ln_weight * F.get(_table(1 / gamma_quantiles()), at) + b)
    ln_a = ln_c - r * (t - b + 1)
    name = term.bitwiseXOR(F.shiftleft(t, 8)).bitwiseXOR(t).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.shiftleft(((ln_a + LN_SHIFT) * LN_SCALE).cast("bigint"), 32).bitwiseOR(name)


def spaced(text: Column) -> Column:
    """The lower-cased text with a space for each other ASCII white space: single characters split fast."""
    text = F.lower(text)
    for c in "\n\r\t\v\f":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def signatures(rows: DataFrame, keys: list[str], text_col: str, samples: int = SAMPLES) -> DataFrame:
    """keys with signature (array<int>) of each row's text.

    keys name a row; if rows are already distributed by some of them, nothing
    is exchanged.
    """
    body = spaced(F.col(text_col))
    words = F.when(F.btrim(body) == "", F.array(F.lit(""))).otherwise(F.split(body, " "))
    exploded = rows.select(*keys, F.explode(words).alias("word"), (F.btrim(body) == "").alias("blank"))
    terms = exploded.where("word <> '' OR blank").select(*keys, F.xxhash64("word").alias("term"))
    counted = terms.groupBy(*keys, "term").agg(F.count("*").alias("n")).select(*keys, "term", F.ln(F.col("n").cast("double")).alias("ln_weight"))
    blocks = F.explode(F.array(*(F.lit(b * BLOCK) for b in range(samples // BLOCK))))
    spread = counted.select(*keys, "term", "ln_weight", blocks.alias("block"))
    drawn = spread.select(*keys, "block", *(sample(F.col("term"), F.col("ln_weight"), F.col("block") + k).alias(f"s{k}") for k in range(BLOCK)))
    least = drawn.groupBy(*keys, "block").agg(*(F.min(f"s{k}").alias(f"s{k}") for k in range(BLOCK)))
    names = F.array(*(F.col(f"s{k}").bitwiseAND(F.lit(0xFFFFFFFF)) for k in range(BLOCK)))
    gathered = least.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", names.alias("names")))).alias("parts"))
    return gathered.select(*keys, F.flatten(F.transform("parts", lambda x: x["names"])).alias("signature"))


def as_text(signature: Column) -> Column:
    """Eight hex digits for each sample."""
    return F.lower(F.array_join(F.transform(signature, lambda x: F.lpad(F.hex(x), 8, "0")), ""))


def likeness(a: Column, b: Column) -> Column:
    """The share of equal samples: an estimate of the generalised Jaccard similarity."""
    same = F.filter(F.zip_with(a, b, lambda x, y: x == y), lambda x: x)
    return F.size(same) / F.size(a).cast("double")


def edited_report(docs: DataFrame, samples: int = SAMPLES, text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has its last floor(n_chars / 2) code points replaced by the
    first as many of the next document's, by descending id; the first document
    comes after the last. Null texts are empty. Rows that repeat an id stand in
    the order of a hash of their texts, rows without an id come last. An empty
    table gives an empty table. Other columns are not read.

    The order is cut into slots of about SLOT_BYTES at quantiles of the ids,
    and each slot is sorted for itself. Only the quantiles and one id of each
    slot reach the driver. Rows that repeat an id share a slot.
    """
    spark = docs.sparkSession
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SLOT_BYTES), 2)
    bounds = texts.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("b")).first()["b"]
    bounds = sorted(set(bounds or []))
    placed = texts.withColumn("slot", place_among(F.col("id"), bounds))

    heads = sorted(((r["slot"], r["id"]) for r in placed.groupBy("slot").agg(F.max("id").alias("id")).collect()), reverse=True)
    after = [(s, *heads[(i + 1) % len(heads)]) for i, (s, _) in enumerate(heads)]
    succeeds = F.broadcast(spark.createDataFrame(after, "of_slot int, next_slot int, head_id bigint"))  # a row for each slot
    by_hash = F.struct(F.xxhash64("text"), F.col("text"))
    head_text = placed.join(succeeds, (F.col("slot") == F.col("next_slot")) & F.col("id").eqNullSafe(F.col("head_id"))).groupBy("of_slot").agg(F.max(by_hash).alias("head")).select("of_slot", F.col("head.text").alias("head_text"))

    order = Window.partitionBy("slot").orderBy(F.desc_nulls_last("id"), F.desc(F.xxhash64("text")), F.desc("text"))
    # Each slot is a task's: partitions of several slots would hold more terms than fit in memory.
    dealt = placed.repartition(len(bounds) + 1, "slot")
    lined = dealt.withColumn("place", F.row_number().over(order)).withColumn("next_text", F.lead("text").over(order))
    lined = lined.join(head_text, F.col("slot") == F.col("of_slot"), "left").withColumn("next_text", F.coalesce("next_text", "head_text"))
    n_chars = F.length("text")
    half = F.floor(n_chars / 2).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n_chars - half), F.substring("next_text", F.lit(1), half))
    kinds = F.explode(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")), F.struct(F.lit(1).alias("kind"), edited.alias("body"))))
    bodies = lined.select("slot", "place", kinds.alias("x")).select("slot", "place", "x.kind", "x.body")
    own, other = (F.max(F.when(F.col("kind") == k, F.col("signature"))) for k in (0, 1))
    both = signatures(bodies, ["slot", "place", "kind"], "body", samples).groupBy("slot", "place").agg(own.alias("own"), other.alias("other"))
    # The rest of a row joins after the terms are added up: groups of terms have short keys.
    facts = lined.select("slot", "place", "id", n_chars.cast("bigint").alias("n_chars"), F.sha2(edited.cast("binary"), 256).alias("edited_sha256"))
    rows = stage(facts.join(both, ["slot", "place"]), "fingerprints")

    inner = Window.partitionBy("slot").orderBy("place")
    first = F.broadcast(rows.where("place = 1").join(succeeds, F.col("slot") == F.col("next_slot")).select("of_slot", F.col("own").alias("head")))  # a row for each slot
    known = rows.withColumn("next_own", F.lead("own").over(inner)).join(first, F.col("slot") == F.col("of_slot"), "left")
    return known.select(
        F.col("id").alias(id_col), "n_chars", "edited_sha256",
        as_text(F.col("own")).alias("fingerprint"), as_text(F.col("other")).alias("edited_fingerprint"),
        likeness(F.col("own"), F.col("other")).alias("near_edited"),
        likeness(F.col("own"), F.coalesce("next_own", "head")).alias("near_next"),
    )


def _longs(values: list[int]) -> Column:
    """An array literal: a constant that the optimiser folds once."""
    return F.split(F.lit(",".join(map(str, values))), ",").cast("array<bigint>") if values else F.array().cast("array<bigint>")


def place_among(value: Column, bounds: list[int]) -> Column:
    """How many of the sorted bounds are at most the value: first among every width-th bound, then among those up to the next. Null is before all."""
    width = max(1, math.isqrt(len(bounds)))
    coarse = F.size(F.filter(_longs(bounds[width - 1 :: width]), lambda x: x <= value))
    # From here on the bounds of the same part: the array is cut, not searched.
    rest = F.slice(_longs(bounds), coarse * width + 1, F.lit(width))
    return F.when(value.isNull(), F.lit(0)).otherwise(coarse * width + F.size(F.filter(rest, lambda x: x <= value))).cast("int")
