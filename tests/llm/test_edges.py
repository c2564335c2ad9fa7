"""Odd rows and tables for the classifiers and every pipeline stage, and the queries' folds."""

import random
import re
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as p
from attestry.llm import mixing, quality, toxicity, weighted_sampling
from attestry.llm.common import stage, table

SF = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def test_scores_are_those_of_one_document_at_a_time():
    rng = np.random.default_rng(5)
    model = quality.fit([rng.random((n, quality.FEATURES)).astype(np.float32) for n in (1, 3, 2, 5)], np.array([0, 1, 0, 1], np.float32))
    text = "Alpha beta GAMMA beta beta 12 " * 60
    bag = [(np.asarray(quality.features([part])[0], float) - model.mean) / model.scale for part in quality.passages(text)]
    hidden = [np.tanh(z @ model.encode + model.encode_b) for z in bag]
    gate = [float((np.tanh(h @ model.v) / (1 + np.exp(-(h @ model.u)))) @ model.w) for h in hidden]
    weight = np.exp(gate) / np.exp(gate).sum()
    want = 1 / (1 + np.exp(-(sum(a * h for a, h in zip(weight, hidden)) @ model.out + model.out_b[0])))
    assert len(bag) == 6 and quality.scores(model, ["x", text, ""])[1] == pytest.approx(want, rel=1e-4)


def risk(x, positive, prior, w, b):
    """The non-negative risk, example by example."""
    loss = lambda z, y: float(np.log1p(np.exp(-z if y else z)))
    z = [float(row @ w + b) for row in x]
    p_pos = np.mean([loss(v, 1) for v, q in zip(z, positive) if q])
    p_neg = np.mean([loss(v, 0) for v, q in zip(z, positive) if q])
    u_neg = np.mean([loss(v, 0) for v, q in zip(z, positive) if not q])
    return prior * p_pos + max(0.0, u_neg - prior * p_neg)


def test_no_classifier_near_by_has_a_smaller_risk():
    rng = np.random.default_rng(6)
    x = rng.random((150, 3))
    positive = np.arange(150) < 30
    x[:30, 0] += 0.6
    x[30:60, 0] += 0.6  # positives among the unlabelled
    w, b = toxicity.fit_nnpu(x, positive, 0.25, steps=3000, decay=0.0)
    found = risk(x, positive, 0.25, w, b)
    others = [risk(x, positive, 0.25, w + rng.normal(0, 0.3, 3), b + rng.normal(0, 0.3)) for _ in range(300)]
    assert found <= min(others) + 0.01 and found < risk(x, positive, 0.25, np.zeros(3), np.log(1 / 3))


def odd_documents(spark, toxic=False):
    rng = random.Random(17)
    draw = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    rows = [(f"d{i}", draw(60) + (" vile grimy" if toxic and i % 2 else "") if i % 2 else draw(40).upper() + " !!", i) for i in range(60)]
    rows += [("d3", rows[3][1], 3), ("d5", "other text", 5), (None, "no id", 0), ("e0", None, 0), ("e1", "", 0), ("long", draw(30_000), 0)] + [("hot", "the same row", 0)] * 300
    return spark.createDataFrame(rows, "doc_id string, text string, key int").withColumn("label", F.lit("clash")).withColumn("n", F.lit(1.5)).withColumn("positive", F.lit("y"))


@pytest.mark.parametrize("module, label", [(quality, "quality"), (toxicity, "toxic")])
def test_classifiers_of_odd_tables(spark, module, label):
    docs = odd_documents(spark, toxic=True)
    labels = docs.select("doc_id", (F.col("key") % 2).alias(label), "key").unionByName(spark.createDataFrame([("d1", 0, 1), ("d1", None, 1), (None, 1, 1), ("hot", 0, 0)], f"doc_id string, {label} int, key int"))
    model, again = module.train(docs, labels, label), module.train(docs.repartition(7), labels.repartition(5), label)
    scored = module.score(docs, model)
    got = scored.collect()
    assert scored.columns == ["doc_id", "score"] and len(got) == docs.count() and all(0 <= r.score <= 1 for r in got)
    of = {}
    for r in got:
        of.setdefault(r.doc_id, set()).add(r.score)
    assert of["e0"] == of["e1"] and len(of["hot"]) == 1 and len(of["d3"]) == 1 and len(of["d5"]) == 2
    assert {r.doc_id: r.score for r in module.score(docs, again).where("doc_id = 'd7'").collect()} == {r.doc_id: r.score for r in got if r.doc_id == "d7"}
    assert module.score(docs.limit(0), model).count() == 0 and module.score(docs, module.train(docs.limit(0), labels, label)).where("score between 0 and 1").count() == docs.count()


def test_training_bounds_hold_for_whole_documents(spark):
    docs = odd_documents(spark).where("doc_id is not null")
    labels = docs.select("doc_id", (F.col("key") % 2).alias("quality")).distinct()
    seen = []
    real = quality.fit
    try:
        quality.fit = lambda bags, label, **k: seen.append([len(b) for b in bags]) or real(bags, label, **k)
        quality.train(docs, labels, train_passages=20)
        quality.train(docs, labels, train_docs=4)
    finally:
        quality.fit = real
    assert 0 < sum(seen[0]) <= 20 and len(seen[1]) == 4 and max(seen[0]) < 400


@here
@pytest.mark.parametrize("name, n, zero, least", [("op1_quality", 5, 0, 0.3), ("op5_toxicity", 3, 1, 0.7)])
def test_folds_of_the_queries(spark, name, n, zero, least):
    from attestry.llm.queries import QUERIES

    got = QUERIES[name](spark, str(SF))
    assert dict(got.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    rows = got.collect()
    assert len(rows) == table(spark, str(SF), "documents").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % n == zero) and r.predicted == (r.score >= least) for r in rows)


def test_places_among_bounds(spark):
    from bisect import bisect_right

    rng = random.Random(3)
    for bounds in ([], [5], sorted(rng.sample(range(1000), 50)), sorted(rng.sample(range(1000), 97))):
        values = [*range(-1, 1001, 7), *bounds, None]
        got = [r[0] for r in spark.createDataFrame([(v,) for v in values], "v bigint").select(weighted_sampling.place_among(F.col("v"), bounds)).collect()]
        assert got == [0 if v is None else bisect_right(bounds, v) for v in values]


def test_blank_texts_have_one_empty_word(spark):
    df = spark.createDataFrame([(3, "   "), (2, ""), (1, " \n\t ")], "doc_id bigint, text string")
    assert len({r.fingerprint for r in weighted_sampling.edited_report(df).collect()}) == 1


def test_neighbours_over_many_slots(spark, monkeypatch):
    rng = random.Random(18)
    texts = {i: " ".join(rng.choice("abcdefgh") * 3 for _ in range(rng.randint(0, 30))) for i in rng.sample(range(-500, 500), 120)}
    rows = [*texts.items(), (None, "no id"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    few = sorted(map(str, weighted_sampling.edited_report(df).collect()))
    monkeypatch.setattr(weighted_sampling, "SLOT_BYTES", 200)
    assert sorted(map(str, weighted_sampling.edited_report(df.repartition(5)).collect())) == few


def brute_flow(capacity, member, quota):
    """The largest flow and its least cost, by trying all."""
    from itertools import product

    ways = []
    for c, m in zip(capacity, member):
        ways.append([(t, sum(max(0, sum(t) - k * c) for k in (1, 2))) for t in product(*(range(3 * c + 1) for _ in m)) if sum(t) <= 3 * c])
    best = (1, 0)
    for choice in product(*ways):
        got = [0] * len(quota)
        for m, (t, _) in zip(member, choice):
            for s, w in zip(m, t):
                got[s] += w
        if all(g <= q for g, q in zip(got, quota)):
            best = min(best, (-sum(got), sum(cost for _, cost in choice)))
    return best


def test_the_flow_is_the_cheapest_of_the_largest():
    rng = random.Random(19)
    for _ in range(150):
        n_s = rng.randint(1, 2)
        capacity = [rng.randint(0, 2) for _ in range(rng.randint(1, 3))]
        member = [sorted(rng.sample(range(n_s), rng.randint(1, n_s))) for _ in capacity]
        quota = [rng.randint(0, 6) for _ in range(n_s)]
        flow = mixing.min_cost_flow(capacity, member, quota)
        sizes = [sum(to.values()) for to in flow]
        assert all(x <= 3 * c for x, c in zip(sizes, capacity)) and all(sum(to.get(s, 0) for to in flow) <= q for s, q in enumerate(quota))
        assert (-sum(sizes), sum(max(0, x - k * c) for x, c in zip(sizes, capacity) for k in (1, 2))) == brute_flow(capacity, member, quota)


def odd_corpus(spark):
    """Rows with each oddity, and columns whose names stages use themselves."""
    rng = random.Random(20)
    draw = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n))
    shared = draw(80)
    texts = [draw(120) for _ in range(12)] + [draw(30) + " " + shared, shared + " " + draw(40), None, "", " ", "x", draw(20_000)]
    rows = [(i, t, "en", f"s{i % 3}" if i % 5 else None, len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[2], rows[2], (100, rows[4][1], "en", "s1", 10), (None, rows[5][1], "en", "s1", 10), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_chars bigint")
    for name in ("quality_score", "drop_id", "span_id", "spans", "mix_pattern", "mix_key", "mix_of", "mix_parts", "mix_copies", "mix_copy", "id", "key", "fp", "Slot"):
        df = df.withColumn(name, F.lit("kept"))
    return df


@here
def test_stages_take_odd_rows(spark):
    docs = odd_corpus(spark)
    for name, function in p.STAGES:
        out = function(spark, docs, str(SF))
        got, none = out.collect(), function(spark, docs.limit(0), str(SF))
        assert none.count() == 0 and none.columns == out.columns
        ids = [r.doc_id for r in got]
        if name == "encoding":
            assert len(got) == docs.count()
            continue
        assert out.columns == docs.columns and all(r.mix_key == r.span_id == "kept" for r in got)
        if name == "near_duplicates":
            assert ids.count(None) == 2 and ids.count(2) == 1 and 100 not in ids and {14, 15, 16} & set(ids) == {14}
        if name == "substrings":
            text = {r.doc_id: r.text for r in got}
            assert ids.count(2) == 3 and 100 not in ids and text[14] is None and text[15] == "" and len(text[13].split()) == 40 and len(text[12].split()) == 110 and ids.count(None) == 2
        if name == "mixing":
            assert not {14, 15, 16} & set(ids) and 18 in ids and ids.count(2) % 3 == 0
        if name == "quality":
            assert {r.doc_id for r in got} <= {r.doc_id for r in docs.collect()}


def jaccard(a, b):
    return len(a & b) / len(a | b) if a | b else 1.0


def grams(text, n):
    """All runs of n words; of a text with fewer words, for the comparison of documents, all of them."""
    w = [x for x in re.split(r"[\x20\x09-\x0d]+", "".join(c.lower() if c.isascii() else c for c in text or "")) if x]
    return {" ".join(w[i : i + n]) for i in range(len(w) - n + 1)} or ({" ".join(w)} if w and n == 5 else set())


@here
def test_pipeline_against_brute_force(spark):
    import hashlib

    import public_tokenizers
    from tokenizers import Tokenizer

    docs = table(spark, str(SF), "documents")
    kept = {}
    for name, function in p.STAGES:
        docs = stage(function(spark, docs, str(SF)), f"brute-{name}")
        kept[name] = docs.collect()
    # Near-duplicates: all pairs of sets of five words.
    before = {r.doc_id: grams(r.text, 5) for r in kept["quality"]}
    root = {i: i for i in before}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in before:
        for j in before:
            if j < i and jaccard(before[i], before[j]) >= 0.8:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    assert {r.doc_id for r in kept["near_duplicates"]} == {i for i in before if find(i) == i}
    # Passages: none of 50 words stays in two documents, and what went was in an earlier one.
    after, seen = {r.doc_id: r.text for r in kept["substrings"]}, {}
    for i in sorted(after):
        for g in grams(after[i], 50):
            assert seen.setdefault(g, i) == i
    was = {r.doc_id: r.text for r in kept["near_duplicates"]}
    lost = {i for i in was if after.get(i) != was[i]}
    fives = {i: grams(t, 5) for i, t in was.items()}
    for i in lost:
        gone = fives[i] - grams(after.get(i), 5)
        assert any(len(gone & fives[j]) >= 30 for j in was if j < i)
    # The mix: whole copies, near the targets.
    size = {r.doc_id: len(r.text.split()) for r in kept["substrings"]}
    copies = {}
    for r in kept["mixing"]:
        copies[r.doc_id] = copies.get(r.doc_id, 0) + 1
    of = {r.doc_id: r.source for r in kept["substrings"]}
    names = sorted(set(of.values()), key=lambda s: (s is None, s or ""))
    sizes = {s: sum(size[i] for i in of if of[i] == s) for s in names}
    target = mixing.capped_targets({str(s): v for s, v in sizes.items()}, {str(s): (5, 2, 1)[k % 3] for k, s in enumerate(names)}, 3)
    assert max(copies.values()) <= 3
    for s in names:
        taken = sum(size[i] * n for i, n in copies.items() if of[i] == s)
        assert abs(taken - target[str(s)]) <= 1 + 2 * max(size[i] for i in of if of[i] == s)
    # Encoding: the library's.
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, hashlib.sha256(b"".join(x.to_bytes(4, "little") for x in library.encode(r.text, add_special_tokens=False).ids)).hexdigest()) for r in kept["mixing"])
    assert sorted((r.doc_id, r.ids_sha256) for r in kept["encoding"]) == want
    final = p.run(spark, str(SF))
    assert sorted(map(tuple, final.collect())) == sorted(map(tuple, kept["encoding"]))
