"""Toxicity by non-negative positive-unlabelled learning.

Only confirmed toxic examples carry a label. All other text is unlabelled, and
a share of it, the class prior, is toxic as well. The risk of a classifier is
estimated as

    prior * loss(positive, 1) + max(0, loss(unlabelled, 0) - prior * loss(positive, 0)),

where the second part, the risk on negative text, is kept from going negative
(when it does, training steps back along it). The classifier is linear over
how densely a text holds terms (words, and beginnings of words, which stand
for the inflected forms that no example shows) that far more toxic examples
hold than texts at large. A long text may hold one by chance.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import Batches, Memo, mapped, stage, texts_of

WORD = re.compile(r"[^\W\d_]+")
#: Lengths of the beginnings of words that are terms; they end in a hyphen.
BEGINNINGS = (4, 5)
#: Words that are added to a text's length where densities are taken.
SHORT = 25
#: Bounds of the training sample, whose documents are chosen by a hash of their ids.
POSITIVES = 4000
UNLABELLED = 8000
#: Terms that the classifier may use.
TERMS = 400
#: A term is used if it is in so many toxic examples and, beyond chance, so many times commoner there.
LEAST_EXAMPLES = 3
LEAST_LIFT = 3.0
LEAST_G = 12.0
STEPS = 800
#: Ids that are looked at for each one of a sample.
SPARE = 4


def words_of(text: str) -> list[str]:
    return WORD.findall(text.lower())


def terms(word: str) -> list[str]:
    """The terms of a word: itself and its beginnings."""
    return [word, *(word[:n] + "-" for n in BEGINNINGS if len(word) > n)]


def densities(counts, n_words: int):
    """Occurrences in a hundred words; a few words more keep those of very short texts small."""
    return 100.0 * counts / (n_words + SHORT)


@dataclass
class Model:
    weight: dict[str, float]
    bias: float

    def scorer(self):
        """A function from a whole text to the probability that it is toxic, with a memory of words."""
        of = _WordWeights(self.weight)

        def score(text: str) -> float:
            words = words_of(text)
            x = self.bias + densities(sum([of[w] for w in words]), len(words))
            return float(1 / (1 + np.exp(-np.clip(x, -30, 30))))

        return score


class _WordWeights(Memo):
    """word -> the weights of its terms."""

    def __init__(self, weight: dict[str, float]):
        super().__init__(200_000)
        self.weight = weight

    def compute(self, word: str) -> float:
        return sum(self.weight.get(t, 0.0) for t in terms(word))


def fit_nnpu(x: np.ndarray, positive: np.ndarray, prior: float, steps: int = STEPS, decay: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias of the linear classifier with the smallest non-negative risk, by Adam over all rows."""
    xp, xu = x[positive], x[~positive]
    w, b = np.zeros(x.shape[1]), np.log(prior / (1 - prior))
    m, s = np.zeros(len(w) + 1), np.zeros(len(w) + 1)
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -30, 30)))
    grad = lambda rows, d: np.append(rows.T @ d, d.sum()) / max(1, len(rows))
    for step in range(1, steps + 1):
        zp, zu = xp @ w + b, xu @ w + b
        g_pos = grad(xp, sigmoid(zp) - 1)  # of log(1 + exp(-z))
        g_neg = grad(xu, sigmoid(zu)) - prior * grad(xp, sigmoid(zp))  # of log(1 + exp(z))
        negative_risk = np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean()
        g = prior * g_pos + g_neg if negative_risk >= 0 else -g_neg
        g[:-1] += decay * w
        m += 0.1 * (g - m)
        s += 0.001 * (g * g - s)
        move = 0.05 * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
        w, b = w - move[:-1], b - move[-1]
    return w, float(b)


def _terms(docs: DataFrame) -> DataFrame:
    """Each row's terms with their counts, and its number of words; docs has id, text and positive."""

    def run(batches: Batches) -> Batches:
        for b in batches:
            words = [words_of(t) for t in texts_of(b)]
            counts = [Counter(t for w in ws for t in terms(w)) for ws in words]
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), b.column("positive"), pa.array([list(c) for c in counts], pa.list_(pa.string())), pa.array([list(c.values()) for c in counts], pa.list_(pa.int32())), pa.array([len(ws) for ws in words], pa.int32())],
                names=["id", "positive", "words", "counts", "n_words"],
            )

    return mapped(docs, run, "id string, positive boolean, words array<string>, counts array<int>, n_words int")


def some_ids(ids: DataFrame, most: int) -> DataFrame:
    """The `most` different ids with the smallest hashes, or all if there are fewer.

    Only ids with a small hash, some times as many as are wanted, are made
    distinct. How many different ids there are is an estimate from sketches
    that are merged, so ids aren't exchanged for it; the sketch is far nearer
    than that factor, so the smallest are always among them. Repeated ids
    count once; an empty table gives an empty table.
    """
    share = min(1.0, SPARE * most / max(1, ids.agg(F.approx_count_distinct("id")).first()[0]))
    small = F.shiftrightunsigned(F.xxhash64("id"), 1)
    return ids.where(small <= F.lit(min((1 << 63) - 1, int(share * (1 << 63))))).distinct().orderBy(small, "id").limit(most)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Fit on at most POSITIVES toxic examples and UNLABELLED documents of all.

    labels holds only rows that may be learned from, docs only documents that
    may be looked at. The class prior is the share of label 1 among labels;
    labels 0 are otherwise not used, their documents are unlabelled text. Of
    an id's labels the largest counts, and of rows that repeat an id the one
    with the smallest text; ids may be of any type, null ids and labels are
    left out, null texts are empty, texts are read whole. Without a toxic
    example all scores are low. Other columns are not read.
    """
    known = labels.select(F.col(id_col).cast("string").alias("key"), F.col(label_col).cast("int").alias("label")).where("key IS NOT NULL AND label IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))
    n, n_toxic = known.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0))).first()
    prior = (n_toxic + 1) / (n + 2)
    texts = docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).cast("string").alias("text")).where("id IS NOT NULL")
    mixed = F.xxhash64("id"), F.col("id")
    toxic = known.where("label = 1").select(F.col("key").alias("id")).orderBy(*mixed)
    u_ids = some_ids(texts.select("id"), UNLABELLED)  # of all text, so that the prior is its toxic share
    p_ids = toxic.join(texts.select("id"), "id", "left_semi").orderBy(*mixed).limit(POSITIVES)
    chosen = F.broadcast(p_ids.withColumn("positive", F.lit(True)).unionByName(u_ids.withColumn("positive", F.lit(False))))
    sample = texts.join(chosen, "id").groupBy("id", "positive").agg(F.min("text").alias("text"))
    rows = stage(_terms(sample), "toxicity-sample")
    n_p, n_u = (int(v or 0) for v in rows.agg(F.count_if("positive"), F.count_if(~F.col("positive"))).first())
    if not n_p or not n_u:
        return Model({}, float(np.log(prior / (1 - prior))) if n else -3.0)
    seen = rows.select("positive", F.explode("words").alias("word")).groupBy("word").agg(F.count_if("positive").alias("p"), F.count_if(~F.col("positive")).alias("u"))
    # How often negative text holds the term: the unlabelled rate less the toxic part of it.
    rate_p, rate_u = (F.col("p") + 0.5) / (n_p + 1), (F.col("u") + 0.5) / (n_u + 1)
    rate_n = F.greatest((rate_u - prior * rate_p) / (1 - prior), F.lit(0.5 / (n_u + 1)))
    # The likelihood ratio, so that what only a few examples hold and no other text counts, too.
    g = 2 * n_p * (rate_p * F.ln(rate_p / rate_n) + (1 - rate_p) * F.ln((1 - rate_p) / (1 - rate_n)))
    chosen_terms = [r["word"] for r in seen.where((F.col("p") >= LEAST_EXAMPLES) & (rate_p > LEAST_LIFT * rate_n)).withColumn("g", g).where(F.col("g") >= LEAST_G).orderBy(F.desc("g"), "word").limit(TERMS).collect()]
    place = {t: i for i, t in enumerate(sorted(chosen_terms))}
    wanted = F.array(*map(F.lit, place)) if place else F.array().cast("array<string>")
    held = F.map_filter(F.map_from_arrays("words", "counts"), lambda k, _: F.array_contains(wanted, k))
    got = sorted(rows.select("id", "positive", "n_words", held.alias("held")).collect(), key=lambda r: (r["id"], r["positive"]))
    x, positive = np.zeros((len(got), len(place))), np.array([r["positive"] for r in got])
    for i, r in enumerate(got):
        for t, c in r["held"].items():
            x[i, place[t]] = densities(c, r["n_words"])
    w, b = fit_nnpu(x, positive, prior)
    return Model({t: float(w[i]) for t, i in place.items()}, b)


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and a score from 0 to 1 for each whole text.

    Null texts score as empty ones do; repeated rows and equal texts score
    alike; very long texts count whole; an empty table gives an empty table.
    Only the text is an input. Columns that are not kept don't appear, so only
    kept ones could clash with name, which is the caller's.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # at most TERMS words

    def run(batches: Batches) -> Batches:
        of = sent.value.scorer()
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array([of(t) for t in texts_of(b, text_col)], pa.float64())], names=schema.names)

    return mapped(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)
