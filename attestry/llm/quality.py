"""Document quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words and only the bag has a label.
Each passage is encoded (its byte distribution and some word statistics,
through one learned layer); gated attention,

    weight_k  ~  exp(w . (tanh(V h_k) * sigmoid(U h_k))),

says how much each passage counts, and a logistic unit scores the weighted sum
of the encodings. All parameters are learned together from document labels, in
numpy, on a bounded sample. Every passage of every document is scored.
"""

from __future__ import annotations

from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from attestry.llm.common import Batches, mapped, stage, texts_of, unstage

PASSAGE = 64
HIDDEN = 24
#: Bounds of the training sample: labelled documents, taken in the order of a hash of their ids, and passages of all
#: of them together. A document is in it with all its passages or not at all.
TRAIN_DOCS = 3000
TRAIN_PASSAGES = 60_000
EPOCHS = 8
BATCH_DOCS = 32
#: Few documents are gone over more often, until so many batches are done.
LEAST_STEPS = 400
#: Byte counts, then the statistics of word_statistics().
STATISTICS = 7
FEATURES = 256 + STATISTICS


def word_statistics(words: list[bytes], joined: bytes) -> tuple[float, ...]:
    """Of a passage: shares of different words and of words that repeat the one before, mean length, share of different pairs of neighbours, number of words, shares of words in capitals and of words of letters alone."""
    n = len(words)
    if not n:
        return (0.0,) * STATISTICS
    again = sum(a == b for a, b in zip(words, words[1:]))
    capitals = sum(w.isupper() and len(w) > 1 for w in words)
    plain = sum(w.isalpha() for w in words)
    return len(set(words)) / n, again / n, len(joined) / n / 16, len(set(zip(words, words[1:]))) / n, n / PASSAGE, capitals / n, plain / n


def passages(text: str) -> list[tuple[list[bytes], bytes]]:
    """The passages of a whole text, at least one."""
    words = text.encode().split()
    parts = [words[i : i + PASSAGE] for i in range(0, len(words), PASSAGE)] or [[]]
    return [(p, b" ".join(p)) for p in parts]


def features(parts: list[tuple[list[bytes], bytes]]) -> np.ndarray:
    """A row for each passage: square roots of byte shares, and word statistics."""
    out = np.empty((len(parts), FEATURES), np.float32)
    for i, (words, joined) in enumerate(parts):
        out[i, :256] = np.bincount(np.frombuffer(joined, np.uint8), minlength=256)
        out[i, 256:] = word_statistics(words, joined)
    np.sqrt(out[:, :256] / np.maximum(out[:, :256].sum(1, keepdims=True), 1), out=out[:, :256])
    return out


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    encode: np.ndarray  # FEATURES x HIDDEN
    encode_b: np.ndarray
    v: np.ndarray  # HIDDEN x HIDDEN
    u: np.ndarray
    w: np.ndarray  # HIDDEN
    out: np.ndarray  # HIDDEN
    out_b: np.ndarray  # 1

    def trained(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)][2:]

    def forward(self, x: np.ndarray, starts: np.ndarray) -> tuple:
        """x: rows of passages, those of a document together from starts on."""
        sizes = np.diff(np.append(starts, len(x)))
        z = (x - self.mean) / self.scale
        h = np.tanh(z @ self.encode + self.encode_b)
        tv, su = np.tanh(h @ self.v), 1 / (1 + np.exp(-np.clip(h @ self.u, -30, 30)))
        e = (tv * su) @ self.w
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        a = e / np.repeat(np.add.reduceat(e, starts), sizes)
        bag = np.add.reduceat(h * a[:, None], starts, axis=0)
        score = 1 / (1 + np.exp(-np.clip(bag @ self.out + self.out_b[0], -30, 30)))
        return score, bag, a, tv, su, h, z, sizes

    def gradients(self, x: np.ndarray, starts: np.ndarray, label: np.ndarray) -> list[np.ndarray]:
        """Of the mean log loss, in the order of trained()."""
        score, bag, a, tv, su, h, z, sizes = self.forward(x, starts)
        d = (score - label) / len(label)
        d_bag = np.repeat(d[:, None] * self.out, sizes, axis=0)
        along = (d_bag * h).sum(1)
        d_e = a * (along - np.repeat(np.add.reduceat(a * along, starts), sizes))
        d_gate = d_e[:, None] * self.w
        d_v, d_u = d_gate * su * (1 - tv**2), d_gate * tv * su * (1 - su)
        d_h = (d_bag * a[:, None] + d_v @ self.v.T + d_u @ self.u.T) * (1 - h**2)
        return [z.T @ d_h, d_h.sum(0), h.T @ d_v, h.T @ d_u, d_e @ (tv * su), bag.T @ d, np.array([d.sum()], np.float32)]


def fit(bags: list[np.ndarray], label: np.ndarray, seed: int = 1) -> Model:
    """Train on bags of passage features. Without both labels the score is the share of label 1."""
    rng = np.random.default_rng(seed)
    init = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[0])).astype(np.float32)
    x = np.concatenate(bags) if bags else np.zeros((1, FEATURES), np.float32)
    model = Model(x.mean(0), x.std(0) + 0.02, init(FEATURES, HIDDEN), np.zeros(HIDDEN, np.float32), init(HIDDEN, HIDDEN), init(HIDDEN, HIDDEN), init(HIDDEN), np.zeros(HIDDEN, np.float32), np.zeros(1, np.float32))
    share = (label.sum() + 1) / (len(label) + 2)
    model.out_b[0] = np.log(share / (1 - share))
    if not len(label) or label.min() == label.max():
        return model
    params = model.trained()
    m, s, step = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params], 0
    sizes = np.array([len(b) for b in bags])
    epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH_DOCS // len(bags)))
    for epoch in range(epochs):
        rate = 0.004 * (1 - epoch / epochs) + 0.0002
        order = rng.permutation(len(bags))
        for at in range(0, len(order), BATCH_DOCS):
            take = order[at : at + BATCH_DOCS]
            starts = np.concatenate([[0], np.cumsum(sizes[take])[:-1]])
            grads = model.gradients(np.concatenate([bags[i] for i in take]), starts, label[take].astype(np.float32))
            step += 1
            for p, g, mi, si, decay in zip(params, grads, m, s, (1e-3, 0, 1e-3, 1e-3, 0, 1e-3, 0)):
                g = g + decay * p
                mi += 0.1 * (g - mi)
                si += 0.001 * (g * g - si)
                p -= (rate * (mi / (1 - 0.9**step)) / (np.sqrt(si / (1 - 0.999**step)) + 1e-7)).astype(np.float32)
    return model


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", train_docs: int = TRAIN_DOCS, train_passages: int = TRAIN_PASSAGES, text_col: str = "text", id_col: str = "doc_id") -> Model:
    """Fit on at most train_docs documents with a label and train_passages passages, in the order of a hash of their ids.

    labels holds only rows that may be learned from. Of an id's labels the
    largest counts, and of rows that repeat an id the one with the smallest
    text; ids may be of any type, null ids and labels are left out, null texts
    are empty. Documents are in the sample as a whole; those after which
    train_passages would be exceeded are not. Without a label the score is
    the same for all texts. Other columns are not read. Passage features are
    computed on the executors, and what reaches the driver is bounded.
    """
    known = labels.select(F.col(id_col).cast("string").alias("key"), F.col(label_col).cast("int").alias("label")).where("key IS NOT NULL AND label IS NOT NULL").groupBy("key").agg(F.max("label").alias("label"))
    order = F.xxhash64("key"), F.col("key")
    chosen = F.broadcast(known.orderBy(*order).limit(train_docs))
    texts = docs.select(F.col(id_col).cast("string").alias("key"), F.col(text_col).cast("string").alias("text"))
    rows = texts.join(chosen, "key").groupBy("key", "label").agg(F.min("text").alias("text"))

    def run(batches: Batches) -> Batches:
        for b in batches:
            bags = [passages(t) for t in texts_of(b)]
            made = pa.array([features(parts).astype(np.float16).tobytes() for parts in bags], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("key"), b.column("label"), pa.array([len(parts) for parts in bags], pa.int32()), made], names=["key", "label", "n", "bag"])

    sample = stage(mapped(rows, run, "key string, label int, n int, bag binary"), "quality-sample")
    # At most train_docs rows are added up in one task.
    fits = sample.where(F.col("n") <= train_passages).withColumn("total", F.sum("n").over(Window.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow))).where(F.col("total") <= train_passages)
    got = sorted(fits.select("key", "label", "bag").collect(), key=lambda r: r["key"])
    unstage(sample)
    return fit([np.frombuffer(r["bag"], np.float16).reshape(-1, FEATURES).astype(np.float32) for r in got], np.array([r["label"] for r in got], np.float32))


def scores(model: Model, texts: list[str]) -> np.ndarray:
    """The scores of whole texts, to nine places.

    Passages of many texts are encoded together, in doubles, so that what
    else is in a block changes no place that is kept.
    """
    model = Model(*(np.asarray(getattr(model, f.name), np.float64) for f in fields(Model)))
    bags = [passages(t) for t in texts]
    out = np.empty(len(texts))
    at = 0
    while at < len(texts):
        end, n = at, 0
        while end < len(texts) and (end == at or n + len(bags[end]) <= 4096):
            n += len(bags[end])
            end += 1
        x = features([p for bag in bags[at:end] for p in bag])
        starts = np.concatenate([[0], np.cumsum([len(bag) for bag in bags[at:end]])[:-1]]).astype(int)
        out[at:end] = np.round(model.forward(x.astype(np.float64), starts)[0], 9)
        at = end
    return out


def score(docs: DataFrame, model: Model, name: str = "score", text_col: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The kept columns and a score from 0 to 1 for each whole text.

    Null texts score as empty ones do; repeated rows and equal texts score
    alike; very long texts are scored whole, in blocks of passages; an empty
    table gives an empty table. Only the text is an input. Columns that are
    not kept don't appear, so only kept ones could clash with name, which is
    the caller's.
    """
    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField(name, T.DoubleType())])
    sent = docs.sparkSession.sparkContext.broadcast(model)  # some 40 kB

    def run(batches: Batches) -> Batches:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in keep), pa.array(scores(sent.value, texts_of(b, text_col)), pa.float64())], names=schema.names)

    return mapped(docs.select(*dict.fromkeys([*keep, text_col])), run, schema)
