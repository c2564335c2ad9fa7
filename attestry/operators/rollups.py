"""Summaries over a batch of audited sites."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions.urls import first_match

FAILED = ["collector_failed", "scorer_failed", "no_report"]
#: (substrings of an issue, its cause), the first that matches counts.
CAUSES = [
    (["not in telemetry", "not corroborated"], "fabricated"),
    (["paraphrased"], "paraphrase"),
    (["no matching text found"], "unlocatable"),
    (["no policy text was retrieved", "unavailable", "could not be checked"], "missing_input"),
]
CAUSE_NAMES = ["fabricated", "unlocatable", "paraphrase", "missing_input", "inconsistency"]


def rate(n: Column, d: Column) -> Column:
    return F.try_divide(n.cast("double"), d.cast("double"))


def status_totals(rows: DataFrame) -> DataFrame:
    """Attempted, scored, blocked and failed sites, and the share of blocked ones."""
    return rows.agg(
        F.count("*").alias("attempted"), F.count_if(F.col("status").isin("ok", "reused") & F.col("score").isNotNull()).alias("scored"),
        F.count_if(F.col("status") == "blocked").alias("blocked"), F.count_if(F.col("status").isin(FAILED)).alias("failed"),
        F.round(rate(F.count_if(F.col("status") == "blocked"), F.count("*")), 6).alias("blocked_rate"),
    )


def by_sector(rows: DataFrame) -> DataFrame:
    return rows.groupBy("sector").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.sum("fails").alias("fails"), F.sum("dimensions").alias("dimensions"), F.round(100 * rate(F.sum("fails"), F.sum("dimensions")), 4).alias("fail_pct"))


def confound(rows: DataFrame) -> DataFrame:
    """By number of policies: sites, mean score, mean grounding of those that have it (0 if none has)."""
    return rows.groupBy("policies").agg(F.count("*").alias("n"), F.round(F.avg("score"), 4).alias("mean_score"), F.round(F.coalesce(F.avg("grounding"), F.lit(0.0)), 4).alias("mean_grounding"))


def two_arms(rows: DataFrame) -> DataFrame:
    """Mean score without and with policies, and the difference if both arms have sites."""
    without, with_ = (F.avg(F.when(c, F.col("score"))) for c in (F.col("policies") == 0, F.col("policies") > 0))
    return rows.agg(F.round(without, 4).alias("mean_without"), F.round(with_, 4).alias("mean_with"), F.round(with_ - without, 4).alias("difference"))


def verdict_pivot(rows: DataFrame, row: str, value: str, values: list[str]) -> DataFrame:
    """Counts of each value by row, zeros kept, and how many different values there are."""
    counts = [F.count_if(F.col(value) == v).alias(f"n_{v.lower()}") for v in values]
    return rows.groupBy(row).agg(*counts, F.count_distinct(value).alias("n_distinct"))


def issue_buckets(issues: DataFrame) -> DataFrame:
    """By the text before the first colon: how many, and the first example. issues: (pos, issue)."""
    kind = F.substring_index("issue", ":", 1)
    return issues.groupBy(kind.alias("bucket")).agg(F.count("*").alias("n"), F.substring(F.min_by("issue", "pos"), 1, 110).alias("example"))


def flag_causes(issues: DataFrame) -> DataFrame:
    """Counts of all causes, also of those without an issue."""
    from functools import reduce

    cause = first_match([(reduce(lambda x, y: x | y, (F.contains("issue", F.lit(w)) for w in words)), name) for words, name in CAUSES], "inconsistency")
    counted = issues.groupBy(cause.alias("cause")).agg(F.count("*").alias("n"))
    names = issues.sparkSession.createDataFrame([(c,) for c in CAUSE_NAMES], "cause string")
    return names.join(counted, "cause", "left").select("cause", F.coalesce("n", F.lit(0)).alias("n"))
