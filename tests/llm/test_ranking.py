"""Ranked search against all documents scored one by one."""

import math
import random
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest

from attestry.llm import queries, ranking

SF = Path("/root/testdata/sf0.001")
TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return TERM.findall(re.sub("[A-Z]", lambda x: x[0].lower(), text or ""))


def plain(docs, items, k):
    texts = [(i, Counter(terms(t))) for i, t in docs]
    held = [(i, c) for i, c in texts if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    w = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * v + 1))) for t, v in df.items()}
    out = []
    asked = {}
    for i, t in dict.fromkeys(items):
        if i is not None:
            asked.setdefault(i, Counter()).update(terms(t))
    for item, q in asked.items():
        scores = []
        for i, c in held:
            m = 100 - 25 + 25 * sum(c.values()) * n_docs // n_terms
            s = sum(q[t] * w[t] * (1000000000 * c[t] // (1000 * c[t] + 12 * m)) for t in q if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=str)


def found(df):
    return sorted([(r.item_id, r["rank"], r.doc_id, r.score) for r in df.collect()], key=str)


def corpus(seed, n=300):
    rng = random.Random(seed)
    words = [w + s for w in ("ab", "Cd", "é", "日本", "x1", "No", "q", "ZZ", "mn", "rare") for s in ("", "a", "b", "12", "É")]
    weights = [1 / (1 + i) for i in range(len(words))]
    text = lambda n: rng.choice([" ", "-", "\n", "_"]).join(rng.choices(words, weights, k=n))
    docs = [(i, text(rng.choice([1, 3, 20, 80]))) for i in range(n)]
    docs += [(n + i, docs[7][1]) for i in range(60)] + [(5, docs[5][1]), (None, docs[6][1]), (None, None), (9000, None), (9001, ""), (9002, "?! --"), (9003, text(20_000))]
    items = [(i, text(rng.choice([1, 2, 6, 30]))) for i in range(25)] + [(100, None), (101, ""), (102, "nowhere"), (103, docs[7][1]), (None, "ab"), (104, "ab Ab aB"), (104, "cd"), (104, "cd")]
    return docs, items


@pytest.mark.parametrize("seed,k,parts,room", [(1, 20, 1, None), (2, 3, 7, None), (3, 1, 3, None), (4, 5, 4, 0), (5, 1000, 2, None)])
def test_equals_scoring_all(spark, monkeypatch, seed, k, parts, room):
    if room is not None:  # everything goes by exchange
        monkeypatch.setattr(ranking, "BROADCAST_BYTES", room)
        monkeypatch.setattr("attestry.llm.common.BROADCAST_BYTES", room)
    docs, items = corpus(seed)
    d = spark.createDataFrame([(i, t, "x", 0) for i, t in docs], "doc_id bigint, text string, item string, score int").repartition(parts)
    q = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int")
    assert found(ranking.ranked(d, q, k)) == plain(docs, items, k)


def test_terms_are_those_of_the_pattern():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("aZ09@[`{\x7f\x00\t \x85\xa0é日\U0001f600/:") for _ in range(40))
        assert [t.decode() for t in ranking.terms_of(text)] == terms(text)


def test_pruning_leaves_terms_out(spark):
    """A frequent word beside a rare one names no candidates, and the rows are the same."""
    docs = [(i, "the " * (1 + i % 3) + ("gold " * 3 if i % 10 == 0 else "") + f"w{i}") for i in range(400)]
    items = [(1, "the gold"), (2, "the")]
    d, q = spark.createDataFrame(docs, "doc_id bigint, text string"), spark.createDataFrame(items, "item_id bigint, text string")
    index = ranking.counted(d.selectExpr("doc_id AS row", "doc_id AS id", "text"), "text", ["row", "id"])
    wanted = spark.createDataFrame([("the",), ("gold",)], "term string")
    total = sum(len(t.split()) for _, t in docs)
    bounds = ranking.term_bounds(index, wanted, 400, total, 20)
    plan = {(r.item, r.term): r for r in ranking.pruned(spark.createDataFrame([(1, "the", 1), (1, "gold", 1), (2, "the", 1)], "item int, term string, q bigint"), bounds).collect()}
    assert not plan[1, "the"].names and plan[1, "gold"].names and plan[1, "gold"].rest > 0 and plan[2, "the"].names and plan[2, "the"].rest == 0
    assert found(ranking.ranked(d, q, 20)) == plain(docs, items, 20)


def test_empty_tables(spark):
    d, q = spark.createDataFrame([(1, "a")], "doc_id bigint, text string"), spark.createDataFrame([(1, "a")], "item_id bigint, text string")
    assert ranking.ranked(d.where("false"), q).count() == 0 and ranking.ranked(d, q.where("false")).count() == 0
    assert found(ranking.ranked(d, q)) == plain([(1, "a")], [(1, "a")], 20)


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_query_equals_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    cursor = con.execute(queries.ORACLES["op13_ranking"])
    columns = [c[0] for c in cursor.description]
    want = sorted([tuple(dict(zip(columns, r))[c] for c in ("item_id", "rank", "doc_id", "score")) for r in cursor.fetchall()], key=str)
    assert found(queries.op13_ranking(spark, str(SF))) == want and len(want) > 100
