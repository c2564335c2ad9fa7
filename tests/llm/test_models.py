"""Classifiers: gradients, held-out accuracy, and odd inputs; mixing against its rules."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.llm import mixing, quality, toxicity


def test_gradients_are_those_of_the_loss():
    rng = np.random.default_rng(0)
    shapes = [(quality.FEATURES, 5), (5,), (5, 5), (5, 5), (5,), (5,), (1,)]
    model = quality.Model(np.zeros(quality.FEATURES), np.ones(quality.FEATURES), *(rng.standard_normal(s) * 0.3 for s in shapes))
    x, starts, label = rng.standard_normal((9, quality.FEATURES)) * 0.2, np.array([0, 2, 7]), np.array([1.0, 0.0, 1.0])
    loss = lambda: -np.mean([np.log(s if y else 1 - s) for s, y in zip(model.forward(x, starts)[0], label)])
    for p, g in zip(model.trained(), model.gradients(x, starts, label)):
        for at in [tuple(rng.integers(0, n) for n in p.shape) for _ in range(4)]:
            keep = p[at]
            p[at] = keep + 1e-5
            up = loss()
            p[at] = keep - 1e-5
            down = loss()
            p[at] = keep
            assert g[at] == pytest.approx((up - down) / 2e-5, abs=1e-6)


def corpus(seed, n):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(["ta", "re", "on", "el", "qui", "sch"]) for _ in range(rng.randint(1, 3)))
    rows = []
    for i in range(n):
        good, toxic = rng.random() < 0.8, rng.random() < 0.2
        w = [word() for _ in range(rng.randint(30, 300))]
        if not good:
            w = [x.upper() + "!!" if rng.random() < 0.9 else x for x in w]
        if toxic:
            for _ in range(4):
                w[rng.randrange(len(w))] = rng.choice(["vile", "grimy"]) + rng.choice(["", "ly", "st", "er"])
        rows.append((i, " ".join(w), int(good), int(toxic)))
    return rows


def test_quality_learns(spark):
    rows = corpus(1, 500)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    model = quality.train(df, df.where("doc_id % 5 <> 0").select("doc_id", "quality"))
    odd = spark.createDataFrame([(1000, None, 0, 0), (1001, "", 0, 0), (1002, "a " * 40_000, 0, 0)], df.schema)
    got = {r.doc_id: r.score for r in quality.score(df.unionByName(odd), model).collect()}
    held = [(got[i], q) for i, _, q, _ in rows if i % 5 == 0]
    assert np.mean([(s >= 0.5) == q for s, q in held]) >= 0.95
    assert got[1000] == got[1001] and all(0 <= s <= 1 for s in got.values())
    none = quality.train(df, df.limit(0).select("doc_id", "quality"))
    assert quality.score(df.limit(3), none).count() == 3 and quality.score(df.limit(0), model).count() == 0


def test_toxicity_learns_from_some_of_the_positives(spark):
    rows = corpus(2, 900)
    df = spark.createDataFrame(rows, "doc_id bigint, text string, quality int, toxic int")
    shown = df.where("doc_id % 3 <> 1")
    model = toxicity.train(shown, shown.where("doc_id % 2 = 0").select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.score(df, model).collect()}
    held = [(got[i], t) for i, _, _, t in rows if i % 3 == 1]
    assert np.mean([(s >= 0.7) == t for s, t in held]) >= 0.95
    nothing = toxicity.train(shown, shown.limit(0).select("doc_id", "toxic"))
    assert toxicity.score(df.limit(2), nothing).where("score < 0.7").count() == 2


def test_the_risk_stays_non_negative():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 2, (60, 40)).astype(float)
    positive = np.arange(60) < 10
    w, b = toxicity.fit_nnpu(x, positive, 0.3, steps=800)
    z = x @ w + b
    assert np.logaddexp(0, z[~positive]).mean() - 0.3 * np.logaddexp(0, z[positive]).mean() > -0.05


def brute_targets(sizes, weights):
    """By small steps: pour the total by weight, never over three times a source."""
    total, got = sum(sizes.values()), dict.fromkeys(sizes, 0.0)
    step = total / 20_000
    for _ in range(20_000):
        open_ = [s for s in sizes if got[s] < 3 * sizes[s] - 1e-9]
        w = sum(weights[s] for s in open_)
        for s in open_:
            got[s] += step * weights[s] / w
    return got


def test_targets():
    sizes, weights = {"a": 10, "b": 500, "c": 40, "d": 900}, {"a": 5, "b": 2, "c": 5, "d": 1}
    got, slow = mixing.capped_targets(sizes, weights, 3), brute_targets(sizes, weights)
    assert all(got[s] == pytest.approx(slow[s], rel=0.01) for s in sizes) and sum(got.values()) == pytest.approx(1450)


def test_flow_repeats_as_little_as_it_can():
    assert mixing.min_cost_flow([10, 10], [[0], [0, 1]], [25, 10]) == [{0: 15}, {0: 10, 1: 10}]
    assert mixing.min_cost_flow([5], [[0]], [100]) == [{0: 15}]
    assert mixing.min_cost_flow([0, 7], [[0], [0]], [7]) == [{}, {0: 7}]


def mixed(spark, n=3000):
    rng = random.Random(4)
    rows = [(i, " ".join(["w"] * rng.randint(0, 60)) if i % 50 else None, rng.choice(["s1", "s2", None, 'q"é', "big", "big", "big"]), 1) for i in range(n)]
    return spark.createDataFrame(rows, "doc_id bigint, text string, source string, target int")


def test_mix(spark):
    df = mixed(spark)
    got = mixing.mix_report(df).collect()
    assert len(got) == 3000 and sorted(got) == sorted(mixing.mix_report(df.repartition(7)).collect())
    source = {r.doc_id: r.source for r in df.collect()}
    sums = {}
    for r in got:
        assert r.taken in (0, r.size, 2 * r.size, 3 * r.size)
        t = sums.setdefault(source[r.doc_id], [0, 0, r.target, r.source_size])
        t[0] += r.size
        t[1] += r.taken
    assert list(sorted(sums, key=lambda s: (s is None, s or ""))) == ["big", 'q"é', "s1", "s2", None]
    for size, taken, target, source_size in sums.values():
        assert size == source_size and abs(taken - target) <= 60
    weight = dict(zip(["big", 'q"é', "s1", "s2", None], [5, 2, 1, 5, 2]))
    want = mixing.capped_targets({str(k): v[0] for k, v in sums.items()}, {str(k): v for k, v in weight.items()}, 3)
    assert all(v[2] == pytest.approx(want[str(k)]) for k, v in sums.items())
    out = mixing.mix_documents(df)
    copies = {r.doc_id: r.n for r in out.groupBy("doc_id").agg(F.count("*").alias("n")).collect()}
    assert out.columns == df.columns and copies == {r.doc_id: r.taken // r.size for r in got if r.taken}


def test_mix_of_overlapping_sources(spark):
    df = spark.createDataFrame([(i, "w " * 10, ["a"] if i % 3 else ["b", "a"]) for i in range(300)], "doc_id bigint, text string, of array<string>")
    rows = mixing.narrow(df, F.transform("of", mixing.source_key), 1)
    mix = mixing.solve(rows, lambda s: [1.0] * len(s))
    got = mix.copies(rows, F.col("pattern"), F.col("key")).select(F.explode("copies").alias("s")).groupBy("s").count().collect()
    words = {r["s"]: 10 * r["count"] for r in got}
    assert all(abs(words[s] - mix.target[s]) <= 20 for s in mix.target)


def test_mix_of_nothing(spark):
    assert mixing.mix_report(mixed(spark, 0)).count() == 0
    blank = spark.createDataFrame([(1, None, "a"), (2, "", "b")], "doc_id bigint, text string, source string")
    assert {(r.size, r.taken, r.target) for r in mixing.mix_report(blank).collect()} == {(0, 0, 0.0)}


def test_some_ids_counts_repeated_ids_once(spark):
    """Rows that repeat an id don't make the sample smaller; it is the ids with the smallest hashes."""
    ids = spark.range(400).selectExpr("cast(id as string) AS id")
    many = ids.crossJoin(spark.range(20).select()).repartition(5)
    got = [r["id"] for r in toxicity.some_ids(many, 50).collect()]
    hashed = ids.selectExpr("id", "shiftrightunsigned(xxhash64(id), 1) AS h").collect()
    assert sorted(got) == sorted(r["id"] for r in sorted(hashed, key=lambda r: (r["h"], r["id"]))[:50])
    assert toxicity.some_ids(many, 1000).count() == 400 and toxicity.some_ids(many.limit(0), 50).count() == 0
