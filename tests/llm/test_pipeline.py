"""The pipeline and the registered queries on the smallest tables."""

from pathlib import Path

import pytest

SF = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not SF.exists(), reason="the driver's tables are not here")


def test_stages(spark):
    import corpus_pipeline as p
    from attestry.llm.common import stage, table

    docs = table(spark, str(SF), "documents")
    columns, sizes = docs.columns, [docs.count()]
    for name, function in p.STAGES[:-1]:
        docs = stage(function(spark, docs, str(SF)), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] >= sizes[3] > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    assert p.STAGES[-1][1](spark, docs, str(SF)).count() == sizes[4]


def test_queries_are_registered(spark):
    import __spark_entry__ as e

    names = [n for n in e.queries() if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11)) and "pipeline" in e.queries()
    got = e.queries()["op10_warc"](spark, str(SF))
    assert got.count() == spark.read.parquet(f"{SF}/pages.parquet").count()


def test_near_duplicate_stage_takes_documents_of_a_similarity_of_08(spark):
    import random

    import corpus_pipeline as p

    rng = random.Random(21)
    draw = lambda n: ["".join(rng.choice("abcdefghij") for _ in range(5)) for _ in range(n)]
    rows = [(None, "x y z"), (None, "x y z"), (900, None), (901, "")]
    for i in range(60):
        base = draw(300)
        near, far = list(base), list(base)
        for at in range(5, 300, 60):
            near[at] = "changed"  # 25 of 296 shingles: a similarity of 0.84
        for at in range(5, 300, 25):
            far[at] = "other"  # 60 of 296: 0.66
        rows += [(i, " ".join(base)), (100 + i, " ".join(near)), (200 + i, " ".join(far)), (300 + i, " ".join(base).upper())]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = p.near_duplicate_stage(spark, df, "")
    got = sorted((r.doc_id is None, r.doc_id or 0) for r in kept.collect())
    assert got == sorted([(True, 0)] * 2 + [(False, i) for i in [*range(60), *range(200, 260), 900]])
    assert p.near_duplicate_stage(spark, df.limit(0), "").count() == 0
