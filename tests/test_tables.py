"""Answers stored once, counts compacted, places in hot groups, names by their rarest run, and the block fold."""

import json
import random
import time
from pathlib import Path

import pytest
from pyspark import TaskContext
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import audit, ordering, policies
from attestry.streaming import captures


def test_no_prompt_is_asked_twice_in_what_is_stored(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(audit, "ASKED_AT_ONCE", 8)
    log, store = tmp_path / "log", f"{tmp_path}/store"
    log.mkdir()

    def answer(prompts):
        task = TaskContext.get()
        with open(log / f"{task.partitionId()}-{task.attemptNumber()}-{time.time_ns()}", "w") as f:
            f.write("\n".join(prompts))
        return [json.dumps({"verdict": "PASS", "score": len(p), "explanation": f"{task.attemptNumber()}"}) if p != "broken" else None for p in prompts]

    rows = [(i, f"prompt {i % 30}") for i in range(300)] + [(300, "broken"), (301, "broken"), (302, None)]
    asked = spark.createDataFrame(rows, "row int, prompt string")
    got = audit.score_with(asked, answer, store=store)
    assert got.count() == len(rows) and got.columns[:3] == ["row", "prompt", "raw_response"]
    stored = spark.read.parquet(store)
    assert stored.count() == stored.select("prompt_digest").distinct().count() == 31
    calls = sum(len(f.read_text().splitlines()) for f in log.iterdir())
    assert calls == 31
    assert {(r.verdict, r.score) for r in got.where("prompt = 'prompt 3'").collect()} == {("PASS", 8)}
    # Known prompts are not asked again, new ones are; what is stored stays.
    before = {tuple(r) for r in stored.collect()}
    more = spark.createDataFrame([(0, "prompt 3"), (1, "broken"), (2, "new"), (3, "new")], "row int, prompt string")
    assert audit.score_with(more, answer, store=store).where("verdict = 'PASS'").count() == 3
    assert sum(len(f.read_text().splitlines()) for f in log.iterdir()) == 32
    after = {tuple(r) for r in spark.read.parquet(store).collect()}
    assert before < after and len(after) == 32
    empty = audit.score_with(asked.limit(0), answer, store=f"{tmp_path}/none")
    assert empty.count() == 0


def test_a_task_that_fails_leaves_no_answer_twice(tmp_path):
    """In a session that tries tasks again: each task's first attempt fails after half its answers."""
    code = f'''
import sys, os
sys.path.insert(0, {str(Path(__file__).resolve().parents[1])!r})
from pyspark import TaskContext
from pyspark.sql import SparkSession
from attestry.operators import audit
spark = SparkSession.builder.master("local[2,3]").config("spark.ui.enabled", "false").config("spark.sql.execution.arrow.maxRecordsPerBatch", "4").getOrCreate()
spark.sparkContext.setLogLevel("OFF")
audit.ASKED_AT_ONCE = 10
seen = {{"n": 0}}
def answer(prompts):
    task = TaskContext.get()
    seen["n"] += 1
    if task.attemptNumber() == 0 and seen["n"] > 1:
        raise RuntimeError("lost")
    open(os.path.join({str(tmp_path)!r}, f"call-{{task.taskAttemptId()}}-{{seen['n']}}"), "w").write(str(len(prompts)))
    return [f'{{{{"verdict": "PASS", "score": {{task.attemptNumber()}}}}}}' for _ in prompts]
asked = spark.createDataFrame([(f"p{{i % 40}}",) for i in range(200)], "prompt string")
n = audit.score_with(asked, answer, store={str(tmp_path / "store")!r}).where("verdict = 'PASS'").count()
stored = spark.read.parquet({str(tmp_path / "store")!r})
print("RESULT", n, stored.count(), stored.select("prompt_digest").distinct().count())
spark.stop()
'''
    import subprocess
    import sys

    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, timeout=300)
    assert "RESULT 200 40 40" in out.stdout, out.stdout[-500:] + out.stderr[-1500:]
    asked = sum(int(f.read_text()) for f in tmp_path.iterdir() if f.name.startswith("call-"))
    assert asked > 40  # so tasks did fail and ask again


def test_compacted_counts_are_those_of_a_batch(spark, tmp_path):
    folder, out, check = tmp_path / "in", f"{tmp_path}/out", f"{tmp_path}/check"
    folder.mkdir()
    line = lambda scan, host, at: json.dumps({"scan": scan, "url": f"https://{host}/x", "ts": at})
    put = lambda name, lines: (folder / name).write_text("\n".join(lines) + "\n")
    run = lambda: captures.run_available(captures.request_counts(spark, str(folder)), out, check)
    rows = lambda df: sorted((r.scan, r.etld1, r.hour, r.n) for r in df.collect())

    def batch():
        every = spark.read.schema("scan string, url string, ts timestamp").json(str(folder))
        return rows(every.groupBy("scan", captures.etld1(captures.url_host(F.col("url"))).alias("etld1"), F.window("ts", "1 hour").start.alias("hour")).agg(F.count("*").alias("n")))

    assert captures.compact(spark, out) is None and captures.counts(spark, out).count() == 0
    put("1.json", [line("s", "a.b.example", "2026-01-01T00:10:00Z")] * 3 + [line("t", "c.example", "2026-01-01T05:00:00Z")])
    run()
    assert rows(captures.counts(spark, out)) == batch()
    first = captures.compact(spark, out)
    assert captures.compact(spark, out) == first and rows(captures.counts(spark, out)) == batch()
    # A second run with more for an hour that is written already, and a file that comes late but within a day.
    put("2.json", [line("s", "b.example", "2026-01-01T00:50:00Z")] * 2 + [line("s", "new.example", "2026-01-01T06:00:00Z")])
    run()
    put("3.json", [line("t", "c.example", "2026-01-01T05:30:00Z"), line("s", "x.b.example", "2026-01-01T00:01:00Z")])
    run()
    assert rows(captures.counts(spark, out)) == batch()
    assert captures.compact(spark, out) > first
    assert rows(captures.counts(spark, out)) == batch() and len(batch()) == 3
    # A compaction that broke off has no mark and does not count.
    broken = Path(out) / "compacted" / "until=999"
    broken.mkdir()
    assert rows(captures.counts(spark, out)) == batch()


@pytest.mark.parametrize("parts", [1, 7])
def test_places_are_row_numbers(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["hot"] * 6 + ["a", "b", None, "c"]), rng.choice([None, 1, 2, 3]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "g string, score int, id int").repartition(5)
    order = [F.asc_nulls_last("score"), F.desc("id")]
    got = {r.id: r.place for r in ordering.places(df, "g", order, parts).collect()}
    want, seen = {}, {}
    for g, s, i in sorted(rows, key=lambda r: (str(r[0]), r[1] is None, r[1] or 0, -r[2])):
        seen[g] = seen.get(g, 0) + 1
        want[i] = seen[g]
    assert got == want
    assert ordering.places(df.limit(0), "g", order, parts).count() == 0


def test_a_hot_group_is_spread(spark):
    df = spark.range(20_000).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id")).alias("g"), F.xxhash64("id").alias("x"))
    dealt = df.repartitionByRange(8, "g", "x").groupBy(F.spark_partition_id()).count()
    assert dealt.agg(F.max("count")).first()[0] < 2 * 20_000 / 8
    assert ordering.places(df, "g", [F.asc("x")], 8).agg(F.max("place"), F.count("*")).first()[:2] == (10_000, 20_000)


def test_names_that_hold_a_stem(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abé_.") for _ in range(n))
    names = [word(rng.randint(0, 12)) for _ in range(300)] + ["abcabcabc", "", None]
    stems = [word(rng.randint(1, 6)) for _ in range(80)] + ["", None, "zzz", "abcabcabcabc", names[0]]
    got = policies.holding(spark.createDataFrame([(s,) for s in stems], "stem string"), spark.createDataFrame([(n,) for n in names], "name string")).collect()
    want = {(s, n) for s in stems for n in names if s and n is not None and s in n}
    assert {tuple(r) for r in got} == want and len(got) == len(want)


def test_block_fold(spark):
    rng = random.Random(1)
    some = ["", " a ", None, "short block", "long block of more than thirty characters 1", "x" * 31, "prefix: long block of more than thirty characters 1, and on", "LONG block, of more than thirty characters: 1!"]

    def plain(blocks):
        kept = []
        for x in blocks:
            x = (x or "").strip(" \t\r\n")
            bare = "".join(c for c in x.lower() if c.isalnum())
            if x and not (len(x) >= 30 and any(bare in k for _, k in kept[-3:])):
                kept.append((x, bare))
        return [x for x, _ in kept]

    lists = [[rng.choice(some) for _ in range(n)] for n in (0, 1, 2, 3, 4, 10, 17, 100, 401)]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(lists)] + [(99, None)], "i int, b array<string>")
    got = {r.i: r.k for r in df.select("i", X.dedupe_blocks(F.col("b")).alias("k")).collect()}
    assert got.pop(99) is None and got == {i: plain(x) for i, x in enumerate(lists)}


def test_block_fold_is_linear(spark):
    def seconds(n):
        blocks = F.transform(F.sequence(F.lit(1), F.lit(n)), lambda i: F.concat(F.lit("one more line of a very long text "), i.cast("string")))
        began = time.time()
        assert spark.range(1).select(F.size(X.dedupe_blocks(blocks))).first()[0] == n
        return time.time() - began

    seconds(1000)
    assert seconds(100_000) < 20 * max(seconds(10_000), 0.5)
