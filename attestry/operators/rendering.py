"""Evidence as text: for prompts by dimension, for whole sites, and for annotators.

The beginnings of lines are fixed values: what reads the texts relies on them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestry.functions import vocab

NO_TELEMETRY = "No behavioural telemetry exists for this scan. Judge on the policy text alone, and prefer NOT_ADDRESSED or less confidence where behaviour would decide."
PROTOCOL = "The crawler interacted with no consent control (first visit, clean profile): a property of the audit, not of the site."
NO_EVENTS = "\nNo event of the relevant kinds was observed, so no behavioural violation may be asserted for this dimension: judge the policy text alone."
NOT_APPLICABLE = "\n(This dimension is about policy text; behavioural evidence does not apply.)"
POTENTIAL = "Findings are POTENTIAL violations, for legal assessment."
COOKIE_KEYS = ("pre_consent_profiling_cookies", "js_set_profiling_cookies")


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit("None"))


def _days(c: Column, unit: str) -> Column:
    """Whole days, half to even as formats round; no lifetime is a session."""
    return F.when(c.isNull(), "session").otherwise(F.concat(F.bround(c, 0).cast("bigint").cast("string"), F.lit(unit)))


def _cookie(c: Column) -> Column:
    return F.concat(F.lit("cookie '"), _text(c["name"]), F.lit("' ("), _text(c["cookie_domain"]), F.lit("), lifetime "), _days(c["lifetime_days"], "d"))


def items_by_key() -> Column:
    """map<evidence key, lines> of an evidence row: what a dimension looks up by its keys."""
    lines = {k: F.transform(k, _cookie) for k in COOKIE_KEYS}
    lines["tracker_requests"] = F.transform("tracker_requests", lambda t: F.concat(_text(t["etld1"]), F.lit(" ["), F.coalesce(t["category"], F.lit("")), F.lit("]")))
    lines["third_party_domains"], lines["fingerprinting_alarms"] = F.col("third_party_domains"), F.col("fingerprinting_alarms")
    return F.create_map(*(x for k, v in lines.items() for x in (F.lit(k), F.coalesce(v, F.array().cast("array<string>")))))


def capped(lines: Column, most: int, before: str = "  - ", more: str = "  ... and %d more") -> Column:
    """The first lines, each behind `before`, and how many there are besides."""
    rest = F.when(F.size(lines) > most, F.array(F.format_string(more, F.size(lines) - most))).otherwise(F.array().cast("array<string>"))
    return F.concat(F.transform(F.slice(lines, 1, most), lambda x: F.concat(F.lit(before), x)), rest)


def by_dimension(evidence: DataFrame, dimensions: DataFrame, most: int = 12, most_json: int = 2000) -> DataFrame:
    """(scan, dimension, evidence_text, has_events): the evidence of each dimension's keys.

    evidence: rows of evidence.assemble(). dimensions: (dimension,
    evidence_keys), a small fixed table, so the product grows with the scans
    only. Lists show the first `most` items, the comparison of declared and
    actual the first characters of its JSON.
    """
    held = evidence.select("scan", "first_party", "consent_ui_detected", "tracker_list_mode", items_by_key().alias("items"), F.to_json("declared_vs_actual").alias("dva"))
    wide = held.crossJoin(F.broadcast(dimensions.select("dimension", "evidence_keys")))
    head = F.array(F.concat(F.lit("Scan of "), _text(F.col("first_party")), F.lit(".")), F.lit(PROTOCOL), F.concat(F.lit("Consent UI present on the page: "), _text(F.col("consent_ui_detected")), F.lit(".")), F.concat(F.lit("Tracker classification mode: "), F.col("tracker_list_mode"), F.lit(".")))
    items, none = F.col("items"), F.array().cast("array<string>")

    def of_key(k: Column) -> Column:
        lines = F.coalesce(F.try_element_at(items, k), none)
        some = F.concat(F.array(F.concat(F.lit("\n"), k, F.lit(" ("), F.size(lines).cast("string"), F.lit("):"))), capped(lines, most))
        return F.when((k == "declared_vs_actual") & F.col("dva").isNotNull(), F.array(F.concat(F.lit("\ndeclared_vs_actual: "), F.substring("dva", 1, most_json)))).when(F.size(lines) > 0, some).otherwise(none)

    found = F.flatten(F.transform("evidence_keys", of_key))
    rows = wide.withColumn("found", found)
    tail = F.when(F.size("evidence_keys") == 0, F.array(F.lit(NOT_APPLICABLE))).when(F.size("found") == 0, F.array(F.lit(NO_EVENTS))).otherwise(none)
    return rows.select("scan", "dimension", F.array_join(F.concat(head, F.col("found"), tail), "\n").alias("evidence_text"), (F.size("found") > 0).alias("has_events"))


def of_site(evidence: DataFrame, most: int = 15) -> DataFrame:
    """(scan, evidence_text): the whole evidence of a site, lists capped."""
    none = F.array().cast("array<string>")
    cookies = F.concat(*COOKIE_KEYS)
    life = lambda c: F.when(F.coalesce(c["lifetime_days"], F.lit(0.0)) == 0, "session").otherwise(_days(c["lifetime_days"], " days"))
    cookie_lines = capped(F.transform(cookies, lambda c: F.concat(F.lit("Cookie '"), _text(c["name"]), F.lit("' ("), _text(c["cookie_domain"]), F.lit("). Duration: "), life(c), F.lit("."))), most, more="  ... and %d more.")
    profiling = F.when(F.size(cookies) > 0, F.concat(F.array(F.format_string(f"Potential pre-consent profiling cookies (%d) [third party, tracker-listed, {vocab.PROFILING_DAYS} days or more]:", F.size(cookies))), cookie_lines)).otherwise(F.array(F.lit("No profiling cookies detected before consent.")))
    domains = F.array_sort(F.array_distinct(F.transform("tracker_requests", lambda t: t["etld1"])))
    tracked = F.when(F.size(domains) > 0, F.concat(F.array(F.format_string("Tracker-listed domains contacted (%d):", F.size(domains))), F.transform(F.slice(domains, 1, most), lambda d: F.concat(F.lit("  - "), d)), F.array(F.lit("")))).otherwise(none)
    third = F.concat(F.array(F.format_string("Third-party domains contacted: %d", F.size("third_party_domains"))), capped(F.col("third_party_domains"), most, more="  ... and %d more."))
    alarms = F.when(F.size("fingerprinting_alarms") > 0, F.concat(F.array(F.format_string("Fingerprinting API calls observed (%d):", F.size("fingerprinting_alarms"))), F.transform(F.slice("fingerprinting_alarms", 1, most), lambda a: F.concat(F.lit("  - "), a)), F.array(F.lit("")))).otherwise(none)
    d = F.col("declared_vs_actual")
    counts = F.format_string("Declared vs actual third parties: %d declared, %d observed, %d undeclared.", F.size(d["declared_third_party_domains"]), F.size(d["observed_third_party_domains"]), F.size(d["undeclared_domains"]))
    gone = F.when(F.size(d["undeclared_domains"]) > 0, F.concat(F.array(F.concat(F.lit("Undeclared (discrepancy type: "), _text(d["discrepancy_type"]), F.lit("):"))), F.transform(F.slice(d["undeclared_domains"], 1, most), lambda x: F.concat(F.lit("  - "), x)))).otherwise(none)
    declared = F.when(d.isNotNull(), F.concat(F.array(counts), gone)).otherwise(none)
    head = F.array(F.concat(F.lit("BEHAVIORAL EVIDENCE — "), _text(F.col("first_party"))), F.concat(F.lit("Consent UI detected on page: "), _text(F.col("consent_ui_detected"))), F.concat(F.lit("Tracker classification mode: "), F.col("tracker_list_mode")), F.lit(""))
    blank = F.array(F.lit(""))
    return evidence.select("scan", F.array_join(F.concat(head, profiling, blank, tracked, third, blank, alarms, declared, blank, F.array(F.lit(POTENTIAL))), "\n").alias("evidence_text"))


def for_annotators(evidence: DataFrame, most: int = 6, alarms: int = 3, alarm_chars: int = 60) -> DataFrame:
    """(scan, observed): what was observed, without a word of judgement."""
    none = F.array().cast("array<string>")
    cookies = F.concat(*COOKIE_KEYS)
    life = lambda c: F.when(F.coalesce(c["lifetime_days"], F.lit(0.0)) == 0, "session").otherwise(c["lifetime_days"].cast("bigint").cast("string"))
    some = lambda n, line: F.when(n > 0, F.array(F.concat(F.lit("  "), line))).otherwise(none)
    first = lambda a, f: F.transform(F.slice(a, 1, most), f)
    domains = F.array_sort(F.array_distinct(F.transform("tracker_requests", lambda t: t["etld1"])))
    tp, fp = F.col("third_party_domains"), F.col("fingerprinting_alarms")
    n_requests, undeclared = F.size("tracker_requests"), F.col("declared_vs_actual.undeclared_domains")
    lines = [
        F.array(F.concat(F.lit("consent UI present: "), _text(F.col("consent_ui_detected"))), F.format_string("profiling cookies before consent: %d", F.size(cookies))),
        some(F.size(cookies), F.array_join(first(cookies, lambda c: F.concat(_text(c["name"]), F.lit(" ("), _text(c["cookie_domain"]), F.lit(", "), life(c), F.lit("d)"))), "; ")),
        F.array(F.format_string("third-party domains: %d", F.size(tp))), some(F.size(tp), F.concat(F.array_join(F.slice(tp, 1, most), ", "), F.when(F.size(tp) > most, " …").otherwise(""))),
        F.array(F.format_string("tracker requests: %d", n_requests)), some(n_requests, F.array_join(F.slice(domains, 1, most), ", ")),
        F.array(F.format_string("fingerprinting API calls: %d", F.size(fp))), some(F.size(fp), F.array_join(F.transform(F.slice(fp, 1, alarms), lambda a: F.substring(F.substring_index(a, "COMPLIANCE_ALARM: ", -1), 1, alarm_chars)), "; ")),
        F.when(F.coalesce(F.size(undeclared), F.lit(0)) > 0, F.array(F.format_string("domains observed but not named in policy: %d", F.size(undeclared)))).otherwise(none),
    ]
    return evidence.select("scan", F.array_join(F.concat(*lines), "\n").alias("observed"))


def filled(template: str, **parts: Column) -> Column:
    """The template with each {name} in place of its part; doubled braces stand for single ones, and braces in parts are left alone."""
    pieces, rest = [], template
    while rest:
        at = min((i for i in (rest.find("{"), rest.find("}")) if i >= 0), default=-1)
        if at < 0:
            pieces.append(F.lit(rest))
            break
        pieces.append(F.lit(rest[:at]))
        if rest[at : at + 2] in ("{{", "}}"):
            pieces.append(F.lit(rest[at]))
            rest = rest[at + 2 :]
        else:
            end = rest.index("}", at)
            pieces.append(_text(parts[rest[at + 1 : end]]))
            rest = rest[end + 1 :]
    return F.concat(*pieces) if pieces else F.lit("")
