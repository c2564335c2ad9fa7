"""Evidence of a scan: flat facts from captures, and the assembled row per site."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import cookies as C
from attestry.functions.urls import etld1, url_host
from attestry.operators import trackers

#: Tracker requests that an evidence row lists; the count covers all.
LISTED = 50


def requests(har: DataFrame, strict_compat: bool = False) -> DataFrame:
    """(scan, pos, url, host, etld1, started, headers) of captures; entries without a host are left out."""
    e = har.select("scan", F.posexplode("log.entries").alias("pos", "e"))
    out = e.select("scan", "pos", F.col("e.request.url").alias("url"), F.col("e.startedDateTime").alias("started"), F.col("e.response.headers").alias("headers")).withColumn("host", url_host(F.col("url"), strict_compat))
    return out.where(F.coalesce("host", F.lit("")) != "").withColumn("etld1", etld1(F.col("host")))


def first_party(reqs: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(scan, first_party): the telemetry's, else that of the first request."""
    first = reqs.groupBy("scan").agg(F.min_by("etld1", "pos").alias("of_request"))
    return first.join(telemetry.select("scan", F.col("meta.etld1").alias("of_telemetry")), "scan", "full").select("scan", F.coalesce("of_telemetry", "of_request").alias("first_party"))


def header_cookie_events(reqs: DataFrame, party: DataFrame, tracking: DataFrame, as_of=None, odd_dates: bool = True) -> DataFrame:
    """A row for each Set-Cookie line, with the profiling rule applied. tracking: (domain). odd_dates: also read dates that take Python."""
    lines = reqs.select("scan", "pos", "host", "etld1", "started", F.explode(C.header_cookies(F.col("headers"))).alias("line")).withColumn("c", C.parse_set_cookie(F.col("line")))
    own = F.coalesce(F.nullif(F.ltrim(F.lower(F.try_element_at("c.attributes", F.lit("domain"))), F.lit(".")), F.lit("")), F.col("host"))
    days = C.header_lifetime_days(F.col("c.attributes"), F.to_timestamp("started"), as_of, odd_dates)
    flat = lines.select("scan", "pos", F.col("c.name").alias("name"), F.length("c.value").alias("value_length"), own.alias("cookie_domain"), F.col("host").alias("set_by_host"), F.col("started").alias("set_at"), days.alias("lifetime_days"))
    return _rule(flat, party, tracking, C.long_lived_header(F.col("lifetime_days")))


def browser_cookie_events(telemetry: DataFrame, party: DataFrame, tracking: DataFrame) -> DataFrame:
    """A row for each cookie in the browser's store; the collector says which are of third parties."""
    e = telemetry.select("scan", F.col("meta.captured_at").alias("set_at"), F.posexplode("observed_behavior.cookies.all_cookies").alias("pos", "c"))
    flat = e.select("scan", "pos", F.col("c.name").alias("name"), F.lit(None).cast("int").alias("value_length"), F.ltrim(F.lower("c.domain"), F.lit(".")).alias("cookie_domain"), F.lit(None).cast("string").alias("set_by_host"), "set_at", C.epoch_lifetime_days(F.col("c.expires"), F.to_timestamp("set_at")).alias("lifetime_days"), F.coalesce("c.third_party", F.lit(False)).alias("third_party"))
    return _rule(flat, party, tracking, C.long_lived_browser(F.col("lifetime_days")))


def _rule(flat: DataFrame, party: DataFrame, tracking: DataFrame, long_lived) -> DataFrame:
    t = tracking.select("domain").distinct()
    e = flat.withColumn("etld1", etld1(F.col("cookie_domain"))).withColumn("host_etld1", etld1(F.col("set_by_host"))).join(party, "scan", "left")
    e = e.join(t.select(F.col("domain").alias("_d1")), F.col("etld1") == F.col("_d1"), "left").join(t.select(F.col("domain").alias("_d2")), F.col("host_etld1") == F.col("_d2"), "left")
    if "third_party" not in e.columns:
        e = e.withColumn("third_party", F.col("etld1") != F.col("first_party"))
    e = e.withColumn("is_tracker_domain", F.col("_d1").isNotNull() | F.col("_d2").isNotNull())
    return e.withColumn("session_cookie", F.col("lifetime_days").isNull()).withColumn("profiling", C.is_profiling(F.col("third_party"), F.col("is_tracker_domain"), long_lived)).drop("_d1", "_d2")


def network_summary(requests: DataFrame, keys: list[str] = ("scan",)) -> DataFrame:
    """keys with total, third-party and third-party POST requests, and the sorted hosts of third parties.

    requests: keys, domain, method, third_party. Hosts are counted once
    before they are gathered, so a list is as long as a capture has hosts.
    """
    third = F.coalesce("third_party", F.lit(False))
    counts = requests.groupBy(*keys).agg(F.count("*").alias("total"), F.count_if(third).alias("third_party"), F.count_if(third & (F.upper("method") == "POST")).alias("third_party_posts"))
    hosts = requests.where(third & F.col("domain").isNotNull()).select(*keys, "domain").distinct().groupBy(*keys).agg(F.sort_array(F.collect_list("domain")).alias("third_party_domains"))
    return counts.join(hosts, list(keys), "left").withColumn("third_party_domains", F.coalesce("third_party_domains", F.array().cast("array<string>")))


def script_set(browser: DataFrame, header: DataFrame) -> DataFrame:
    """Profiling cookies of the browser that no header set, profiling or not: by name and registrable domain."""
    return trackers.only_in_first(browser.where("profiling"), header, ["scan", "name", "etld1"])


def tracker_requests(reqs: DataFrame, tracking: DataFrame) -> DataFrame:
    t = tracking.select(F.col("domain").alias("etld1")).distinct()
    return reqs.join(t, "etld1", "left_semi")


def entry_counts(har: DataFrame) -> DataFrame:
    """(scan, total_requests): all entries of a capture, also those without a host."""
    return har.select("scan", F.greatest(F.lit(0), F.coalesce(F.size("log.entries"), F.lit(0))).cast("bigint").alias("total_requests"))


def scanned(reqs: DataFrame, telemetry: DataFrame) -> DataFrame:
    """(scan, scanned_url, fingerprinting_alarms, consent_ui_detected): the telemetry's address, else that of the first request; null where there is no telemetry to tell."""
    first = reqs.groupBy("scan").agg(F.min_by("url", "pos").alias("first_url"))
    t = telemetry.select(
        "scan", F.coalesce("meta.final_url", "meta.url").alias("told"), F.coalesce("observed_behavior.fingerprinting_traps.alarms", F.array().cast("array<string>")).alias("fingerprinting_alarms"),
        (F.coalesce("visual_evidence.interactable_elements.consent_related_count", F.lit(0)) > 0).alias("consent_ui_detected"),
    )
    return first.join(t, "scan", "full").select("scan", F.coalesce("told", "first_url").alias("scanned_url"), F.coalesce("fingerprinting_alarms", F.array().cast("array<string>")).alias("fingerprinting_alarms"), "consent_ui_detected")


DECLARED = "struct<declared_third_party_domains:array<string>,observed_third_party_domains:array<string>,undeclared_domains:array<string>,discrepancy_type:string,undeclared_cookies:array<string>>"


def declared_vs_actual(observed: DataFrame, observed_cookies: DataFrame, declared: DataFrame, declared_cookies: DataFrame | None = None) -> DataFrame:
    """(scan, declared_vs_actual) of the scans that declare anything: what was observed and not declared is neglected.

    observed: (scan, domain) registrable; declared: (scan, domain) any host;
    cookies: (scan, name). All are sets of one scan, joined by scan and item.
    """
    d = declared.select("scan", etld1(F.col("domain")).alias("domain")).distinct()
    seen = observed.select("scan", "domain").distinct()
    gone = trackers.only_in_first(seen, d, ["scan", "domain"])
    gather = lambda df, c, name: df.groupBy("scan").agg(F.sort_array(F.collect_set(c)).alias(name))
    out = gather(d, "domain", "declared_third_party_domains").join(gather(seen, "domain", "observed_third_party_domains"), "scan", "left").join(gather(gone, "domain", "undeclared_domains"), "scan", "left")
    if declared_cookies is None:
        out = out.withColumn("undeclared_cookies", F.lit(None).cast("array<string>"))
    else:
        names = trackers.only_in_first(observed_cookies.where(F.col("name").isNotNull()).select("scan", "name").distinct(), declared_cookies, ["scan", "name"])
        out = out.join(gather(names, "name", "undeclared_cookies"), "scan", "left").withColumn("undeclared_cookies", F.coalesce("undeclared_cookies", F.array().cast("array<string>")))
    some = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    kind = F.when(F.size(some("undeclared_domains")) > 0, "neglect")
    fields = F.struct("declared_third_party_domains", some("observed_third_party_domains").alias("observed_third_party_domains"), some("undeclared_domains").alias("undeclared_domains"), kind.alias("discrepancy_type"), "undeclared_cookies")
    return out.select("scan", fields.cast(DECLARED).alias("declared_vs_actual"))


def assemble(reqs: DataFrame, party: DataFrame, header: DataFrame, browser: DataFrame, tracking: DataFrame, telemetry: DataFrame, totals: DataFrame, categories: DataFrame | None = None, declared: DataFrame | None = None, declared_cookies: DataFrame | None = None, tracker_list_mode: str = "builtin") -> DataFrame:
    """One row per scan: the counts, and the lists that reports show.

    totals: entry_counts(); categories: (domain, category) for tracker
    requests. Only requests to third parties count as contacts and as tracker
    requests. Lists are of one capture, and requests are ranked before the
    first ones are listed.
    """
    third = reqs.join(party, "scan").where(F.col("etld1") != F.col("first_party"))
    listed = Window.partitionBy("scan").orderBy("pos")
    hits = tracker_requests(third, tracking).withColumn("rank", F.row_number().over(listed))
    kinds = categories.select("domain", "category") if categories is not None else tracking.select("domain", F.lit("tracker").alias("category")).distinct()
    hits = hits.join(kinds, F.col("etld1") == F.col("domain"), "left")
    contacts = third.select("scan", F.col("etld1").alias("domain")).distinct()
    contacted = contacts.groupBy("scan").agg(F.sort_array(F.collect_list("domain")).alias("third_party_domains"))
    tracked = hits.groupBy("scan").agg(F.count("*").alias("n_tracker_requests"), F.sort_array(F.collect_list(F.when(F.col("rank") <= LISTED, F.struct("pos", "etld1", F.substring("url", 1, 120).alias("url"), "category")))).alias("tracker_requests"))
    cookie = F.struct("pos", "name", "cookie_domain", F.bround("lifetime_days", 1).alias("lifetime_days"))
    of_header = header.groupBy("scan").agg(
        F.count("*").alias("set_cookie_events"), F.count_if("profiling").alias("n_header"), F.sort_array(F.collect_list(F.when(F.col("profiling"), cookie))).alias("pre_consent_profiling_cookies"),
        F.sort_array(F.collect_list(F.when(~F.col("profiling") & F.col("third_party"), cookie))).alias("other_third_party_cookies"),
    )
    of_script = script_set(browser, header).groupBy("scan").agg(F.count("*").alias("n_script"), F.sort_array(F.collect_list(cookie)).alias("js_set_profiling_cookies"))
    out = party
    for part in (totals, scanned(reqs, telemetry), contacted, tracked, of_header, of_script):
        out = out.join(part, "scan", "left")
    if declared is None:
        out = out.withColumn("declared_vs_actual", F.lit(None).cast(DECLARED))
    else:
        names = header.select("scan", "name").unionByName(browser.select("scan", "name"))
        out = out.join(declared_vs_actual(contacts, names, declared, declared_cookies), "scan", "left")
    n, many = lambda c: F.coalesce(c, F.lit(0)), lambda c: F.coalesce(F.size(c), F.lit(0))
    summary = F.struct(
        n("total_requests").alias("total_requests"), many("third_party_domains").alias("third_party_domains_contacted"), n("n_tracker_requests").alias("tracker_requests"), n("set_cookie_events").alias("set_cookie_events"),
        (n("n_header") + n("n_script")).alias("pre_consent_profiling_cookies"), many("fingerprinting_alarms").alias("fingerprinting_alarms"),
    )
    lists = ["third_party_domains", "tracker_requests", "pre_consent_profiling_cookies", "js_set_profiling_cookies", "other_third_party_cookies", "fingerprinting_alarms"]
    types = dict(out.dtypes)
    return out.select("scan", "first_party", "scanned_url", F.lit(tracker_list_mode).alias("tracker_list_mode"), "consent_ui_detected", summary.alias("summary"), *(F.coalesce(c, F.array().cast(types[c])).alias(c) for c in lists), "declared_vs_actual")
