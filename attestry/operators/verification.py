"""Verification of reports against their evidence, end to end: universe, five checks, issues, rates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import grounding as G
from attestry.operators import verdicts as V

CHECKS = ["C1_citation", "C2_requirement_quote", "C3_policy_quote", "C4_behavioural_claim", "C5_consistency"]


def _strings(c: Column) -> Column:
    return F.coalesce(c, F.array().cast("array<string>"))


def universe(evidence: DataFrame, site: str = "scan") -> DataFrame:
    """(site, known_domains, known_cookies, known_counts, raw): all that an evidence row holds.

    Takes the columns of evidence.assemble(). The site's own domain counts,
    with and without www. An evidence row is one site's and its lists are
    bounded, so this needs no exchange.
    """
    cookies = [F.coalesce(c, F.array().cast("array<struct<name:string,cookie_domain:string>>")) for c in (F.transform(k, lambda x: F.struct(x["name"].alias("name"), x["cookie_domain"].alias("cookie_domain"))) for k in ("pre_consent_profiling_cookies", "js_set_profiling_cookies", "other_third_party_cookies"))]
    every = F.concat(*cookies)
    own = F.array("first_party", F.replace("first_party", F.lit("www."), F.lit("")), F.expr("try_parse_url(scanned_url, 'AUTHORITY')"), F.replace(F.expr("try_parse_url(scanned_url, 'AUTHORITY')"), F.lit("www."), F.lit("")))
    d = F.col("declared_vs_actual")
    domains = F.concat(
        own, _strings(F.col("third_party_domains")), F.coalesce(F.transform("tracker_requests", lambda x: x["etld1"]), F.array().cast("array<string>")), F.transform(every, lambda c: F.ltrim(c["cookie_domain"], F.lit("."))),
        *(_strings(d[k]) for k in ("observed_third_party_domains", "undeclared_domains", "declared_third_party_domains")),
    )
    names = F.concat(F.transform(every, lambda c: c["name"]), _strings(d["undeclared_cookies"]))
    tidy = lambda a: F.array_sort(F.array_distinct(F.filter(F.transform(a, X.norm), lambda x: x != "")))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    counts = F.array(*(F.greatest(F.lit(0), x) for x in (n("third_party_domains"), n("tracker_requests"), n("pre_consent_profiling_cookies") + n("js_set_profiling_cookies"), n("fingerprinting_alarms"))))
    held = F.struct(*(F.col(c) for c in evidence.columns))
    return evidence.select(F.col(site).alias("site"), tidy(domains).alias("known_domains"), tidy(names).alias("known_cookies"), counts.alias("known_counts"), X.norm(F.to_json(held)).alias("raw"))


def verify(rows: DataFrame, evidence: DataFrame | None, policies: DataFrame) -> DataFrame:
    """A row for each dimension of a report: its five checks, issues, and whether it is legacy and grounded.

    rows: (site, dimension, verdict, score, confidence, policy_claim,
    behavioral_evidence, discrepancy_type, breach, retrieved_articles,
    rule_text); those of dry runs are left out. evidence: universe() rows,
    policies: (site, policy_text). Both are one row a site and joined by it;
    a site without evidence has an empty universe, one without policy text
    can't have its quotes checked.
    """
    rows = rows.where(F.col("verdict").isNull() | (F.col("verdict") != "DRY_RUN"))
    none = F.array().cast("array<string>")
    if evidence is None:
        evidence = rows.select("site").limit(0).select("site", none.alias("known_domains"), none.alias("known_cookies"), F.array().cast("array<int>").alias("known_counts"), F.lit("").alias("raw"))
    wide = rows.join(evidence, "site", "left").join(policies, "site", "left")
    wide = wide.withColumns({"known_domains": F.concat(_strings(F.col("known_domains")), F.array(X.norm(F.col("site")), X.norm(F.replace("site", F.lit("www."), F.lit(""))))), "known_cookies": _strings(F.col("known_cookies")), "raw": F.coalesce("raw", F.lit("{}")), "policy_text": F.coalesce("policy_text", F.lit(""))})
    wide = wide.withColumn("known_counts", F.coalesce("known_counts", F.array(*[F.lit(0)] * 4)))
    wide = wide.withColumn("legacy", F.col("retrieved_articles").isNull() & F.col("rule_text").isNull())
    breach = F.col("breach")
    c1 = G.citation_status(breach["article"], breach["regulation"], F.col("retrieved_articles"))
    wide = wide.withColumn("C1_citation", c1)

    has = lambda c: F.coalesce(c, F.lit("")) != ""
    quotations = {
        "C2_requirement_quote": (breach["requirement_text"], F.col("rule_text"), has(F.col("rule_text"))),
        "C3_policy_quote": (F.col("policy_claim"), F.col("policy_text"), has(F.col("policy_text"))),
    }
    wide = G.quote_statuses(wide, {f"_{check[:2]}": (F.when(due, quote), source) for check, (quote, source, due) in quotations.items()})
    wide = wide.withColumns({check: F.when(due, F.col(f"_{check[:2]}.status")).otherwise("N/A") for check, (_, _, due) in quotations.items()})

    claim = F.coalesce("behavioral_evidence", F.lit(""))
    c4 = G.behaviour_issues(claim, F.col("known_domains"), F.col("known_cookies"), F.col("known_counts"), F.col("raw"))
    c5 = V.consistency_issues(F.col("verdict"), F.col("score"), breach["article"], F.col("policy_claim"), F.col("behavioral_evidence"), F.col("discrepancy_type"), has(F.col("policy_text")))
    wide = wide.withColumns({"_c4": c4, "_c5": c5})
    wide = wide.withColumns({"C4_behavioural_claim": G.behaviour_status(claim, F.col("_c4"), F.col("known_domains"), F.col("known_cookies")), "C5_consistency": F.when(F.size("_c5") > 0, "UNSUPPORTED").otherwise("SUPPORTED")})
    got = F.array_join(F.transform("retrieved_articles", lambda r: F.concat_ws(" ", r["regulation"], r["article"])), ", ")
    unsupported = lambda c: F.col(c) == "UNSUPPORTED"
    quoted = lambda c, what, where: F.when(unsupported(c), F.concat(F.lit(f"{c[:2]}: {what} not found in {where} ("), F.col(f"_{c[:2]}.note"), F.lit(", best ratio "), F.col(f"_{c[:2]}.ratio").cast("string"), F.lit(")")))
    single = F.array(
        F.when(unsupported("C1_citation"), F.concat(F.lit("C1: cited "), F.coalesce(breach["regulation"], F.lit("None")), F.lit(" Art "), breach["article"], F.lit(" but retrieval gave ["), got, F.lit("]"))),
        quoted("C2_requirement_quote", "requirement_text", "retrieved law text"),
        F.when(~has(F.col("policy_text")) & has(F.col("policy_claim")), F.lit("C3: policy text unavailable to the verifier, quote could not be checked")).otherwise(quoted("C3_policy_quote", "policy_claim", "scraped policy")),
    )
    issues = F.concat(F.filter(single, lambda x: x.isNotNull()), F.transform("_c4", lambda x: F.concat(F.lit("C4: "), x)), F.transform("_c5", lambda x: F.concat(F.lit("C5: "), x)))
    out = wide.withColumn("issues", issues)
    return out.select("site", "dimension", "verdict", "score", "confidence", *CHECKS, "issues", "legacy", (F.size("issues") == 0).alias("grounded"))


def summary(verified: DataFrame) -> DataFrame:
    """A row for each site: counts, both grounding rates (rounded half-even to 3 places), and a tally of each check."""
    fine, able = F.col("grounded"), ~F.col("legacy")
    rate = lambda n, d: F.bround(F.try_divide(n.cast("double"), d.cast("double")), 3)
    tally = [F.struct(*(F.count_if(F.col(c) == s).alias(a) for s, a in (("SUPPORTED", "supported"), ("UNSUPPORTED", "unsupported"), ("N/A", "na")))).alias(c) for c in CHECKS]
    return verified.groupBy("site").agg(
        F.count("*").alias("dimensions_checked"), F.count_if(able).alias("dimensions_verifiable"), F.count_if(fine).alias("dimensions_fully_grounded"), F.count_if(~fine).alias("dimensions_with_issues"),
        (F.count_if(able) < F.count("*")).alias("legacy_report"), rate(F.count_if(fine & able), F.count_if(able)).alias("grounding_rate"), rate(F.count_if(fine), F.count("*")).alias("grounding_rate_all"), *tally,
    )


def tally(verified: DataFrame) -> DataFrame:
    """(check_id, status, n) over all rows."""
    pairs = F.explode(F.array(*(F.struct(F.lit(c).alias("check_id"), F.col(c).alias("status")) for c in CHECKS))).alias("x")
    return verified.select(pairs).groupBy("x.check_id", "x.status").agg(F.count("*").alias("n"))
