"""The index against all pairs, in order and value, and how many pairs it computes."""

from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from attestry.operators import retrieval as R
from attestry.operators import vector_index as I

SF = Path("/root/testdata/sf0.001")


def clustered(seed, n=900, d=12, groups=20, spread=0.15):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(groups, d))
    x = centres[rng.integers(0, groups, n)] + spread * rng.normal(size=(n, d))
    rows = [(i, [float(np.float32(v)) for v in row], i % 3) for i, row in enumerate(x)]
    return rows + [(n + i, rows[0][1], i % 3) for i in range(40)]  # a group of equal vectors: ties


def frame(spark, rows):
    return R.with_norm(spark.createDataFrame(rows, "chunk_id bigint, embedding array<float>, label int")).withColumn("note", F.lit("x"))


def both(spark, rows, k, keys, lists=None, asked="chunk_id % 100 = 0"):
    v = frame(spark, rows)
    q = v.where(asked).withColumnRenamed("chunk_id", "query_id").drop("note")
    read = lambda df: sorted(((r.query_id, r["rank"], r.chunk_id, r.sim) for r in df.collect()), key=str)
    return read(I.index_top_k(q, v, k, keys, lists)), read(R.top_k(R.similarities(q, v, keys), k))


@pytest.mark.parametrize("k,keys,lists", [(5, [], None), (60, ["label"], 3)])
def test_same_rows_and_values_as_all_pairs(spark, k, keys, lists):
    got, want = both(spark, clustered(k), k, keys, lists)
    assert got == want


def test_slices_and_odd_vectors(spark, monkeypatch):
    monkeypatch.setattr(I, "SLICE_ROWS", 50)
    monkeypatch.setattr(I, "SLICE_QUERIES", 3)
    rows = clustered(4, n=300)
    rows += [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [], 1), (2003, [1.0, 2.0], 2), (2004, [None] + [1.0] * 11, 0), (2005, [1.0] * 12, None)]
    got, want = both(spark, rows, 4, [], asked="chunk_id % 20 = 0 or chunk_id in (2001, 2002)")
    assert got == want
    few, all_of_them = both(spark, rows[-3:] + rows[:2], 10, [], asked="chunk_id < 2")
    assert few == all_of_them and len(few) == 2 * 5


@pytest.mark.parametrize("keys", [[], ["label"]])
def test_slices_of_all_pairs_give_the_same(spark, monkeypatch, keys):
    monkeypatch.setattr(I, "SLICE_ROWS", 64)
    monkeypatch.setattr(I, "SLICE_QUERIES", 5)
    rows = clustered(8, n=300) + [(2000, None, 1), (2001, [0.0] * 12, 1), (2002, [], 1), (2003, [1.0, 2.0], 2), (2004, [None] + [1.0] * 11, 0), (2005, [1.0] * 12, None), (2006, [float("nan")] * 12, 0)]
    v = frame(spark, rows)
    q = v.where("chunk_id % 20 = 0 or chunk_id in (2001, 2002, 2003, 2006)").withColumnRenamed("chunk_id", "query_id").drop("note")
    read = lambda df: sorted((str((r.query_id, r["rank"], r.chunk_id, r.label, r.note, r.sim)) for r in df.collect()))
    assert read(I.nearest(q, v, 4, keys)) == read(R.top_k(R.similarities(q, v, keys), 4))


def test_a_slice_passes_on_k_rows_without_vectors(spark):
    """Also of equal vectors, of which there may be any number."""
    v = frame(spark, [(i, [1.0, 2.0], 0) for i in range(500)])
    q = v.where("chunk_id < 3").withColumnRenamed("chunk_id", "query_id")
    centres = I.fit_centroids(v, 1)
    for got in (I.search(q, I.indexed(v, centres), centres, 5), I.nearest(q, v, 5)):
        assert "embedding" not in got.columns and [r.chunk_id for r in got.orderBy("query_id", "chunk_id").collect()] == [0, 1, 2, 3, 4] * 3


def test_anchors_are_cut_before_the_join(spark):
    chunks = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(99, None)], "chunk_id bigint, label int")
    refs = spark.createDataFrame([(q, q % 3) for q in range(6)] + [(7, 0), (7, 0), (8, None)], "query_id bigint, label int")
    got = R.anchors(refs, chunks, ["label"], 3)
    want = sorted((q, c) for q in range(6) for c in ([0, 2, 4], [1, 3, 5], [])[q % 3]) + [(7, 0), (7, 0), (7, 2)]
    assert sorted((r.query_id, r.chunk_id) for r in got.collect()) == want
    assert "Window" in got._jdf.queryExecution().optimizedPlan().toString().split("Join", 1)[1]


def test_without_vectors(spark):
    got, want = both(spark, clustered(1)[:5], 3, [], asked="false")
    assert got == want == []
    v = R.with_norm(spark.createDataFrame([], "chunk_id bigint, embedding array<float>, label int"))
    assert I.index_top_k(v.withColumnRenamed("chunk_id", "query_id"), v, 3).count() == 0


def test_few_pairs_are_computed(spark):
    """Of clustered vectors most lists are skipped; of any vectors few pairs are computed in full."""
    for rows, skipped in ((clustered(6), True), (clustered(7, spread=50.0, d=48), False)):
        v = frame(spark, rows)
        q = v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")
        centres = I.fit_centroids(v, 20)
        index = I.indexed(v, centres)
        computed = I.search(q, index, centres, 5).count()
        pairs = q.count() * len(rows)
        assert computed * 3 < pairs
        if skipped:
            bounds = I.list_bounds(q, index, centres)
            kth = R.top_k(R.similarities(q, v), 5).groupBy("query_id").agg(F.min("sim").alias("kth"))
            reach = bounds.join(kth, "query_id").where("bound >= kth").agg(F.sum("n")).first()[0]
            assert reach * 3 < pairs


@pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")
def test_a_written_index_gives_the_same(spark, tmp_path):
    v = R.with_norm(spark.read.parquet(f"{SF}/embeddings.parquet")).withColumnRenamed("vec_id", "chunk_id")
    q = v.where("chunk_id % 100 = 0").withColumnRenamed("chunk_id", "query_id")
    centres = I.fit_centroids(v)
    I.indexed(v, centres).write.parquet(f"{tmp_path}/index")
    read = spark.read.parquet(f"{tmp_path}/index")
    assert read.count() == v.count()
    rows = lambda df: sorted((r.query_id, r["rank"], r.chunk_id, r.sim) for r in df.collect())
    assert rows(R.top_k(I.search(q, read, centres, 5), 5)) == rows(R.top_k(R.similarities(q, v), 5))
