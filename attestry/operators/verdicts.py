"""Verdicts: validation of raw responses, the guard, and the overall score."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocab


def parse_response(raw: Column) -> Column:
    """struct(verdict, score, confidence, discrepancy_type) of a model's raw text.

    What is not an object gives ERROR. Verdicts count as they are written,
    unknown ones are PARTIAL. A score is a number or a boolean, cut to an
    integer, or a whole number in a string, within 0 and 100, else null; a
    confidence is a number, a boolean or a number in a string, within 0 and 1,
    else 0.5. The text is parsed once: what follows is a function of one
    array's only element.
    """
    bare = F.regexp_replace(F.trim(raw), r"^```(?:json)?\s*|\s*```$", "")
    parsed = F.try_parse_json(F.nullif(F.regexp_extract(bare, r"(?s)\{.*\}", 0), F.lit("")))
    return F.get(F.transform(F.array(parsed), _response), 0)


def _response(parsed: Column) -> Column:
    get = lambda path: F.try_variant_get(parsed, f"$.{path}", "string")
    kind = lambda path: F.schema_of_variant(F.try_variant_get(parsed, f"$.{path}", "variant"))
    score, confidence = get("score"), get("confidence")
    whole = F.when(score.rlike(r"^\s*[+-]?\d+(_\d+)*\s*$"), F.trim(F.replace(score, F.lit("_"), F.lit(""))).try_cast("double"))
    number = F.when(kind("score") == "BOOLEAN", F.when(score == "true", 1.0).otherwise(0.0)).when(kind("score") == "STRING", whole).otherwise(score.try_cast("double"))
    cut = F.when(number >= 0, F.floor(number)).otherwise(F.ceil(number))
    share = F.when(kind("confidence") == "BOOLEAN", F.when(confidence == "true", 1.0).otherwise(0.0)).when(confidence.rlike(r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(confidence).try_cast("double"))
    within = lambda x, most: F.when(x.isNotNull(), F.least(F.lit(most), F.greatest(F.lit(type(most)(0)), x)))
    ok, verdict, discrepancy = parsed.isNotNull(), get("verdict"), get("discrepancy_type")
    return F.struct(
        F.when(~ok, "ERROR").when(verdict.isin(vocab.VERDICTS), verdict).otherwise("PARTIAL").alias("verdict"),
        within(cut, 100).cast("int").alias("score"),
        F.when(ok, F.coalesce(within(share, 1.0), F.lit(0.5))).otherwise(0.0).alias("confidence"),
        F.when(discrepancy.isin(vocab.DISCREPANCIES), discrepancy).alias("discrepancy_type"),
    )


def is_scored(score: Column, verdict: Column) -> Column:
    return score.isNotNull() & ~verdict.isin("NOT_ADDRESSED", "ERROR")


def severity_weight(severity: Column) -> Column:
    table = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in vocab.SEVERITY_WEIGHT.items()))
    return F.coalesce(F.try_element_at(table, severity), F.lit(1.0))


def band(score: Column) -> Column:
    return F.when(score.isNull(), "INSUFFICIENT_DATA").when(score >= 75, "LIKELY_COMPLIANT").when(score >= 50, "PARTIAL").otherwise("POTENTIAL_NON_COMPLIANCE")


def overall(rows: DataFrame, site: str = "site", extra: tuple[Column, ...] = ()) -> DataFrame:
    """(site, overall_score, overall_verdict, n_scored, n_rows): the severity-weighted mean, rounded half-even; null if nothing was scored. extra: more aggregates of a site's rows."""
    ok = is_scored(F.col("score"), F.col("verdict"))
    w = F.when(ok, severity_weight(F.col("severity")))
    mean = F.try_divide(F.sum(w * F.col("score")), F.sum(w))
    out = rows.groupBy(site).agg(F.bround(mean, 0).cast("int").alias("overall_score"), F.count_if(ok).alias("n_scored"), F.count("*").alias("n_rows"), *extra)
    return out.withColumn("overall_verdict", band(F.col("overall_score")))


def guarded(sites: DataFrame, dimensions: DataFrame, scored: DataFrame) -> DataFrame:
    """Sites by dimensions: a constant row where there is neither policy nor event, the scored row elsewhere.

    sites: (site, has_policy, has_events); dimensions is a small fixed table,
    so the product grows with the sites only.
    """
    plan = sites.crossJoin(F.broadcast(dimensions))
    empty = ~F.col("has_policy") & ~F.col("has_events")
    guard = plan.where(empty).select("site", "dimension", F.lit("NOT_ADDRESSED").alias("verdict"), F.lit(None).cast("int").alias("score"), F.lit(True).alias("guarded"))
    rest = plan.where(~empty).select("site", "dimension").join(scored, ["site", "dimension"]).select("site", "dimension", "verdict", "score", F.lit(False).alias("guarded"))
    return guard.unionByName(rest)


def consistency_issues(verdict: Column, score: Column, article: Column, claim: Column, behaviour: Column, discrepancy: Column, has_policy: Column) -> Column:
    """array<string>: the rules about its own fields that a verdict breaks."""
    has = lambda c: F.coalesce(c, F.lit("")) != ""
    low, high = (F.try_element_at(F.create_map(*chain.from_iterable((F.lit(k), F.lit(v[i])) for k, v in vocab.VERDICT_BAND.items())), verdict) for i in (0, 1))
    rules = [
        F.when((verdict == "NOT_ADDRESSED") & (has(article) | score.isNotNull()), "not addressed, yet cited or scored"),
        F.when((discrepancy == "neglect") & ~has(behaviour), "neglect without behaviour"),
        F.when((discrepancy == "neglect") & has(behaviour) & ~has_policy, "neglect without a policy"),
        F.when(discrepancy.isin("contrary", "inadequate") & ~(has(claim) & has(behaviour)), "contradiction without both sides"),
        F.when((score < low) | (score > high), "score outside its band"),
        F.when(verdict.isin("FAIL", "PARTIAL") & ~has(claim) & ~has(behaviour), "finding without any support"),
    ]
    return F.filter(F.array(*rules), lambda x: x.isNotNull())
