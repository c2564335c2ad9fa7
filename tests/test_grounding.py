"""Quotations against plain searches: the automaton, the bounded fuzzy comparison, and verification in one pass."""

import difflib
import random
from pathlib import Path

import pytest

from attestry.functions import fuzzy, vocab
from attestry.operators import grounding
from attestry.plans import on_captures, on_documents, on_events, on_orders, on_pages  # noqa: F401
from attestry.plans.registry import QUERIES

SF = Path("/root/testdata/sf0.001")
here = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def plain_ratio(quote, source):
    """Every window with the library, in order; the first that is accepted ends it."""
    n, best = len(quote), 0.0
    for at in range(0, max(1, len(source) - n + 1), max(1, n // 4)):
        best = max(best, difflib.SequenceMatcher(None, quote, source[at : at + n]).ratio())
        if best >= vocab.FUZZY_ACCEPT:
            break
    return best


def edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        out[rng.randrange(len(out))] = rng.choice("abc# é")
    return "".join(out)


@pytest.mark.parametrize("alphabet", ["ab", "abcdefgh ", "the quick brown fox jumps over it é日"])
def test_ratios_are_those_of_every_window(alphabet):
    rng = random.Random(len(alphabet))
    for n in [*range(1, 30), 60, 120, 199, 200, 230, 420]:
        for _ in range(12 if n < 100 else 3):
            source = "".join(rng.choice(alphabet) for _ in range(rng.choice([0, n // 2, n, n + 3, 3 * n])))
            quote = "".join(rng.choice(alphabet) for _ in range(n))
            if len(source) > n and rng.random() < 0.6:
                at = rng.randrange(len(source) - n + 1)
                quote = edited(rng, source[at : at + n], rng.choice([0, n // 20, n // 6, n // 3]))
            assert fuzzy.best_ratio(quote, source) == plain_ratio(quote, source), (quote, source)


def test_few_windows_are_compared_to_the_end():
    rng = random.Random(8)
    words = ["".join(rng.choice("etaoinshrdlu") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    all_windows = compared = 0
    for _ in range(20):
        source, quote = text(700), text(20)[:90]
        c = fuzzy.Comparison(quote)
        assert fuzzy.best_ratio(quote, source, c) == plain_ratio(quote, source)
        all_windows += (len(source) - len(quote)) // (len(quote) // 4) + 1
        compared += c.compared
    assert compared * 10 < all_windows


def test_bounds_hold():
    rng = random.Random(9)
    import numpy as np

    for _ in range(400):
        n, alphabet = rng.choice([3, 10, 40, 210]), rng.choice(["ab", "abcdefgh ", "".join(map(chr, range(97, 123)))])
        quote, window = ("".join(rng.choice(alphabet) for _ in range(n)) for _ in range(2))
        window = edited(rng, quote, n // 4) if rng.random() < 0.5 else window
        m = sum(b.size for b in difflib.SequenceMatcher(None, quote, window).get_matching_blocks())
        c = fuzzy.Comparison(quote)
        assert fuzzy.gram_bounds(quote, window, np.array([0]), n)[0] >= m
        assert n < fuzzy.LONG_WINDOW or c.seeds(window) >= m
        assert c.matched(window, -1) == (m, True)
        bound, exact = c.matched(window, m)
        assert not exact and bound <= m or exact and bound == m


def test_quotations_of_any_length_meet_their_texts(spark):
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 4)))
    texts = [(i, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(80)] + [(3, "a b"), (100, None), (101, ""), (102, "long " * 20_000 + "needle end"), (None, "ab")]
    quotes = [(i, " ".join(word() for _ in range(1 + i % 4))) for i in range(60)] + [(200, ""), (201, None), (202, "needle"), (203, "long long needle end"), (0, "second"), (204, texts[5][1]), (205, "b")] * 2
    t, q = spark.createDataFrame(texts, "text_id int, text string").repartition(5), spark.createDataFrame(quotes, "quote_id int, quote string")
    want = {(i, j) for i, a in quotes for j, b in texts if a is not None and b is not None and a in b}
    got = grounding.containing(q, t)
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == want and len(rows) == len(want)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Cross" not in plan and "Generate" not in plan


def test_quotations_in_blocks(spark, monkeypatch):
    """More keys than one pass takes: as many passes, the same rows."""
    monkeypatch.setattr(grounding, "KEYS_AT_ONCE", 30)
    texts = [(i, f"alpha {i} beta gamma{i % 3} delta") for i in range(40)]
    quotes = [(i, f"{i} beta gamma") for i in range(20)] + [(50, "delta"), (51, "")]
    t, q = spark.createDataFrame(texts, "text_id int, text string"), spark.createDataFrame(quotes, "quote_id int, quote string")
    assert {tuple(r) for r in grounding.containing(q, t).collect()} == {(i, j) for i, a in quotes for j, b in texts if a in b}


@here
def test_fuzzy_query_equals_a_plain_search(spark):
    source = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    squeeze = lambda t: " ".join(t.translate(str.maketrans("‘’“”–—\xa0", "''\"\"-- ")).split()).lower()
    some = 0
    for r in QUERIES["q_quote_fuzzy"](spark, str(SF)).collect():
        head = source[r.doc_id][:80]
        quote = squeeze(head if r.doc_id % 3 == 0 else head[:30] + "#" + head[31:80])
        if r.note and r.note.startswith(("near", "para", "no match")) and "..." not in quote:
            some += 1
            want = plain_ratio(quote.strip(" \"'"), squeeze(source[r.doc_id]))
            assert r.ratio == pytest.approx(want, abs=6e-4) and (r.status == "SUPPORTED") == (want >= vocab.FUZZY_ACCEPT)
    assert some > 50


@here
def test_verification_reads_each_table_once(spark):
    plan = QUERIES["q_verify"](spark, str(SF))._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("ArrowEvalPython") == 1
    # Orders twice, as the query makes both its verdicts and its policies of them, and events.
    assert plan.count("FileScan parquet") == 3
