"""Whitening against exact integers and a plain decomposition."""

import math
from fractions import Fraction
from pathlib import Path

import numpy as np
import pytest

from attestry.llm import queries, whitening

SF = Path("/root/testdata/sf0.001")
SCHEMA = "vec_id bigint, embedding array<float>, component string, n string"


def plain(rows, k):
    """By id: (n, exact deviation), whitened up to sign, explained; every sum in fractions or doubles over all rows at once."""
    good = [(i, [math.floor(64 * float(c)) + 1_000_000 for c in v]) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    fit = sorted({tuple(x) for _, x in good})
    n, d = len(fit), len(fit[0])
    s = [sum(x[j] for x in fit) for j in range(d)]
    centred = np.array([[float(Fraction(n * x[j] - s[j], n)) for j in range(d)] for x in fit])
    v = centred.T @ centred / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:k], u[:, ::-1][:, :k]
    out = {}
    for i, x in good:
        y = np.array([float(Fraction(n * x[j] - s[j], n)) for j in range(d)])
        out.setdefault(i, []).append((n, sum((n * a - b) ** 2 for a, b in zip(x, s)), y @ u / np.sqrt(e), e / np.trace(v)))
    return out


def compare(got, want, k):
    by_id = {}
    for r in got:
        by_id.setdefault(r.vec_id, []).append(r)
    assert set(by_id) == set(want)
    signs = np.zeros(k)
    for i, all_of in want.items():
        mine = sorted(by_id[i], key=lambda r: r.component)
        assert len(mine) == k * len(all_of)
        for c in range(k):
            rs = [r for r in mine if r.component == c + 1]
            n, deviation, z, share = all_of[0]
            for r in rs:
                assert r.n == n and r.explained == pytest.approx(share[c], rel=1e-6) and 0 <= r.identity_error < 1e-8
                if not signs[c] and abs(z[c]) > 1e-3:
                    signs[c] = np.sign(z[c]) * np.sign(r.whitened)
                assert abs(r.whitened - signs[c] * z[c]) < 1e-6 * max(1, abs(z[c]))
            assert sorted(r.deviation for r in rs) == sorted(a[1] for a in all_of)


def odd_rows():
    rng = np.random.default_rng(2)
    rows = [(i, [float(np.float32(v)) for v in rng.normal(0, 1, 6) * [5, 4, 3, 2, 1, 0.5] + 7]) for i in range(200)]
    rows += [(i, rows[0][1]) for i in range(200, 900)] + [(3, rows[3][1]), (None, rows[5][1])]
    return rows, [(-1, None), (-2, []), (-3, [1.0] * 5 + [None]), (-4, [float("nan")] + [1.0] * 5), (-5, [float("inf")] + [1.0] * 5), (-6, [1e30] * 6), (-7, [1.0, 2.0])]


@pytest.mark.parametrize("parts", [1, 13])
def test_equals_exact_arithmetic(spark, parts):
    rows, dropped = odd_rows()
    df = spark.createDataFrame([(i, v, "c", "n") for i, v in rows + dropped], SCHEMA).repartition(parts)
    compare(whitening.whiten(df, 4).collect(), plain(rows, 4), 4)
    assert whitening.whiten(df, 16).select("component").distinct().count() == 6  # no more than the vectors have


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_query_on_the_tables(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding) if r.embedding is not None else None) for r in table.collect()]
    compare(queries.op11_whitening(spark, str(SF)).collect(), plain(rows, 16), 16)


def test_without_rows_or_variance(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert whitening.whiten(empty).collect() == [] and whitening.whiten(empty).columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    same = spark.createDataFrame([(i, [1.0, 2.0], "", "") for i in range(9)], SCHEMA)
    assert {(r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in whitening.whiten(same).collect()} == {(1, 0, 0.0, 0.0, 0.0)}
    line = spark.createDataFrame([(i, [float(i), float(2 * i)], "", "") for i in range(9)], SCHEMA)
    got = whitening.whiten(line).collect()
    assert all(r.whitened == 0 and r.explained == 0 for r in got if r.component == 2) and all(abs(r.explained - 1) < 1e-9 and r.identity_error < 1e-9 for r in got if r.component == 1)


def test_large_numbers_stay_exact():
    rng = np.random.default_rng(3)
    x = rng.integers(-(1 << 50), 1 << 50, (40, 3))
    count, high, low = whitening.halves(x)
    assert count.tolist() == [40] * 3 and [(int(h) << whitening.HALF) + int(v) for h, v in zip(high, low)] == [sum(map(int, c)) for c in x.T]
    sums = [int(c.sum()) for c in x.T]
    for scale in (1 << 50, 1 << 20, 100):
        y = x % scale
        sums = [sum(map(int, c)) for c in y.T]
        want = [sum((40 * int(v) - s) ** 2 for v, s in zip(row, sums)) for row in y]
        assert whitening.deviations(y, 40, sums) == [w if w < 1 << 63 else None for w in want]
