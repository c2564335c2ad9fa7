"""A batch audit as one plan: which sites are healthy, what is asked about them, and what came of it."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions import vocab
from attestry.operators import rendering, verdicts
from attestry.sources.scratch import exists, written

#: A capture of fewer requests, or without an element to interact with, was blocked.
LEAST_REQUESTS = 10


def dimensions(spark: SparkSession, ids: list[str] | None = None, behavioural_only: bool = False, table=vocab.DIMENSIONS) -> DataFrame:
    """(place, dimension, law_refs, requirement_type, evidence_keys, severity): all, those asked for in that order, or those with evidence keys. Unknown ids raise KeyError."""
    by_id = {d[0]: d for d in table}
    chosen = [by_id[i] for i in ids] if ids else list(table)
    rows = [(i, *d) for i, d in enumerate(chosen) if d[3] or not behavioural_only]
    return spark.createDataFrame(rows, "place int, dimension string, law_refs string, requirement_type string, evidence_keys array<string>, severity string")


def capture_health(telemetry: DataFrame, least: int = LEAST_REQUESTS, lenient: bool = False) -> DataFrame:
    """(scan, requests, ui_elements, healthy) of telemetry files, one row each.

    A file that is not readable has nulls throughout: it is not healthy in a
    batch and passes where a person looks on (lenient).
    """
    readable = F.col("meta").isNotNull() | F.col("observed_behavior").isNotNull() | F.col("visual_evidence").isNotNull()
    n = F.greatest(F.lit(0), F.coalesce(F.size("observed_behavior.all_requests"), F.lit(0)))
    ui = F.coalesce("visual_evidence.interactable_elements.total", F.lit(0))
    return telemetry.select("scan", n.alias("requests"), ui.alias("ui_elements"), F.when(readable, (n >= least) & (ui > 0)).otherwise(F.lit(lenient)).alias("healthy"))


def prompts(evidence_texts: DataFrame, policies: DataFrame, laws: DataFrame, dims: DataFrame, template: str) -> DataFrame:
    """(scan, dimension, prompt): the dry run of an audit, all that a model would be asked.

    evidence_texts: rendering.by_dimension(); policies: (scan, policy_text);
    laws: (dimension, law_text). dims and laws are small fixed tables.
    """
    rows = evidence_texts.join(policies, "scan", "left").join(F.broadcast(dims.select("dimension", "law_refs", "severity").join(laws, "dimension", "left")), "dimension")
    part = lambda c: F.coalesce(c, F.lit(""))
    prompt = rendering.filled(template, dim_id=F.col("dimension"), law_refs=F.col("law_refs"), law_context=part("law_text"), policy_context=part("policy_text"), evidence_context=F.col("evidence_text"))
    return rows.select("scan", "dimension", "severity", "has_events", prompt.alias("prompt"))


#: Prompts that one task asks: what is asked again if it fails.
ASKED_AT_ONCE = 256


def _asking(answer: Callable[[list[str]], list[str]]):
    @F.pandas_udf("string")
    def of(texts: pd.Series) -> pd.Series:
        return pd.Series(answer(texts.tolist()), index=texts.index, dtype=object)

    return of


def answered(asked: DataFrame, answer: Callable[[list[str]], list[str]], store: str, prompt: str = "prompt") -> DataFrame:
    """(prompt_digest, raw_response) of all prompts, from a stored table of answers that this call brings up to date.

    A prompt is known by the SHA-256 of its text. Those of asked that the
    store, a folder, does not know are asked, each once however many rows
    have it. Spark's commit of the written files takes one attempt of each
    task, so a task that fails and is tried again leaves no answer twice; it
    asks its ASKED_AT_ONCE prompts anew. Of answers that two runs at the same
    time have stored for one prompt the smallest counts. An answer of null is
    stored as such and not asked for again.
    """
    spark = asked.sparkSession
    stored = "prompt_digest string, raw_response string"
    known = spark.read.schema(stored).parquet(store) if exists(spark, store) else spark.createDataFrame([], stored)
    wanted = asked.where(F.col(prompt).isNotNull()).select(F.sha2(F.col(prompt), 256).alias("prompt_digest"), F.col(prompt).alias("_prompt")).dropDuplicates(["prompt_digest"])
    missing = written(wanted.join(known.select("prompt_digest"), "prompt_digest", "left_anti"), "prompts")
    n = missing.count()
    if n or not exists(spark, store):
        spread = missing.repartition(max(1, -(-n // ASKED_AT_ONCE)), "prompt_digest")
        spread.select("prompt_digest", _asking(answer)(F.col("_prompt")).alias("raw_response")).write.mode("append").parquet(store)
    return spark.read.schema(stored).parquet(store).groupBy("prompt_digest").agg(F.min("raw_response").alias("raw_response"))


def score_with(asked: DataFrame, answer: Callable[[list[str]], list[str]], prompt: str = "prompt", store: str | None = None) -> DataFrame:
    """asked with the parsed answers of a function from prompts to raw texts, called once for each Arrow batch.

    The function is the caller's: a model, a cache or a stand-in. An answer
    that is null or no object is an error row, not a failed job. With a store,
    equal prompts are asked once, and those that it has answers for not at
    all: see answered().
    """
    if store is None:
        raw = asked.withColumn("raw_response", _asking(answer)(F.col(prompt)))
    else:
        answers = answered(asked, answer, store, prompt)
        raw = asked.withColumn("_digest", F.sha2(F.col(prompt), 256)).join(answers, F.col("_digest") == F.col("prompt_digest"), "left").select(*asked.columns, "raw_response")
    return raw.withColumn("parsed", verdicts.parse_response(F.coalesce("raw_response", F.lit("")))).select(*asked.columns, "raw_response", "parsed.*")


def status(healthy: Column, n_rows: Column, n_errors: Column) -> Column:
    """What came of a site."""
    return F.when(healthy.isNull(), "collector_failed").when(~healthy, "blocked").when(F.coalesce(n_rows, F.lit(0)) == 0, "scorer_failed").when(n_errors == n_rows, "scorer_failed").otherwise("ok")


def batch(sites: DataFrame, health: DataFrame, scored: DataFrame, verified: DataFrame, policies: DataFrame) -> DataFrame:
    """A record for each site of the list, in the columns of a batch file.

    sites: (domain, sector, jurisdiction); health: capture_health() by
    domain; scored: (domain, dimension, verdict, score, severity); verified:
    verification.summary() by domain; policies: (domain, n_files). Each is
    added up by domain before it is joined.
    """
    v = F.col("verdict")
    counts = scored.groupBy("domain").agg(
        F.count("*").alias("n_dimensions"), F.count_if(v == "FAIL").alias("n_fail"), F.count_if(v == "PARTIAL").alias("n_partial"), F.count_if(v == "PASS").alias("n_pass"),
        F.count_if(v == "NOT_ADDRESSED").alias("n_not_addressed"), F.count_if(v == "ERROR").alias("n_error"),
    )
    totals = verdicts.overall(scored, "domain").select("domain", "overall_score", "overall_verdict")
    rows = sites.join(health.select("domain", "requests", "ui_elements", "healthy"), "domain", "left")
    for part in (counts, totals, verified.select("domain", "grounding_rate", F.col("dimensions_with_issues").alias("dims_with_issues")), policies.select("domain", F.col("n_files").alias("policies_found"))):
        rows = rows.join(part, "domain", "left")
    what = status(F.col("healthy"), F.col("n_dimensions"), F.col("n_error"))
    note = F.when(what == "blocked", F.concat(F.col("requests").cast("string"), F.lit(" requests, "), F.col("ui_elements").cast("string"), F.lit(" UI elements"))).otherwise("")
    return rows.select(
        "domain", "sector", "jurisdiction", what.alias("status"), "requests", "ui_elements", F.coalesce("policies_found", F.lit(0)).alias("policies_found"), "overall_score", "overall_verdict",
        "n_dimensions", "n_fail", "n_partial", "n_pass", "n_not_addressed", "grounding_rate", "dims_with_issues", note.alias("notes"),
    )
