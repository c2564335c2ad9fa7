"""Near-duplicate passages behind earlier documents that hold a looser version of them."""

import random

import numpy as np
import pytest

from attestry.llm import substrings
from attestry.llm.shingles import tokens_of

T = substrings.LEAST_WORDS - substrings.SHINGLE + 1


def decoys(seed, groups, earlier, changes):
    """Documents, and the pairs (later, earlier one) of which the later has one changed word: `earlier` documents with `changes` words changed come first."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghijklmnop") for _ in range(6))
    rows, pairs = [], []

    def changed(passage, n):
        out = list(passage)
        for i in rng.sample(range(len(out)), n):
            out[i] = word()
        return out

    for g in range(groups):
        passage = [word() for _ in range(60)]
        versions = [changed(passage, changes) for _ in range(earlier)] + [passage, changed(passage, 1)]
        first = g * (earlier + 2)
        rows += [(first + i, " ".join([word() for _ in range(rng.randint(20, 80))] + v + [word() for _ in range(rng.randint(20, 80))])) for i, v in enumerate(versions)]
        pairs.append((first + earlier + 1, first + earlier))
    return rows, pairs


@pytest.mark.parametrize("earlier,changes,parts", [(1, 3, 3), (3, 4, 1), (10, 4, 7)])
def test_looser_versions_hide_nothing(spark, earlier, changes, parts):
    rows, pairs = decoys(earlier, 60, earlier, changes)
    texts = dict(rows)
    got = {(r.doc_id, r.source_id) for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(parts)).collect()}
    found = due = 0
    for later, before in pairs:
        tokens, at = tokens_of([texts[later], texts[before]], substrings.SHINGLE)
        a, b = (np.asarray(tokens[s:e]) for s, e in zip(at, at[1:]))
        if substrings.passages_within(a, b, T):
            due += 1
            found += (later, before) in got
    assert due > 40 and found >= 0.97 * due, (found, due)
    assert all(i > j for i, j in got)


def test_gaps_before_last_cuts_are_filled(spark):
    """A source of small documents and a few very long ones comes as near to its target as its smallest documents allow."""
    from attestry.llm import mixing

    rng = random.Random(12)
    rows = [(i, " ".join(["w"] * (5000 if i % 29 == 0 else rng.randint(3, 40))), f"s{i % 4}") for i in range(2400)] + [(5000, None, "s0"), (5001, "", None), (7, "a b c", "s1")]
    got = mixing.mix_report(spark.createDataFrame(rows, "doc_id bigint, text string, source string"), weights=(5, 2, 1)).collect()
    source = {}
    for i, _, s in rows:
        source.setdefault(i, s)
    by = {}
    for r in got:
        taken, target = by.get(source[r.doc_id], (0, 0.0))
        by[source[r.doc_id]] = (taken + r.taken, r.target)
        assert r.taken % max(1, r.size) == 0 and r.taken <= 3 * r.size
    assert all(abs(taken - target) <= max(45, 0.001 * target) for taken, target in by.values()), by


def test_many_sources(spark):
    from pyspark.sql import functions as F

    from attestry.llm import mixing

    d = spark.range(12_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.col("id") % 4000).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 7 + 1).cast("int")).alias("text"))
    got = mixing.mix_report(d).agg(F.count("*").alias("n"), F.max(F.col("taken") - 3 * F.col("size")).alias("over"), (F.sum("taken") / F.sum("size")).alias("share")).first()
    assert got.n == 12_000 and got.over <= 0 and 0.7 < got.share < 1.3
