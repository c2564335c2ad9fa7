"""Captures of our own, from files to the evidence row, and tracker lists."""

import json
import os

import pytest
from pyspark.sql import functions as F

from attestry.operators import agreement, audit, evidence, links, policies, rendering, retrieval, trackers, verification
from attestry.sources import readers, writers
from attestry.streaming import captures

START = "2026-07-01T10:00:00Z"


def entry(url, *cookies):
    return {"startedDateTime": START, "request": {"url": url, "method": "GET", "headers": []}, "response": {"status": 200, "headers": [{"name": "Set-Cookie", "value": c} for c in cookies] + [{"name": "Server", "value": "x"}]}}


@pytest.fixture(scope="module")
def scans(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("scans")
    entries = [
        entry("https://www.shop.example/", "sid=1; Path=/"), entry("https://ads.follow.net/p", "uid=abc; Expires=Mon, 01 Jul 2027 10:00:00 GMT"),
        entry("https://x.count.net/c", "cid=9; Max-Age=31536000\nshort=1; Max-Age=3600"), entry("https://cdn.plain.org/f", "keep=1; Max-Age=31536000"), entry("https://y.count.net/e", "edge=1; Max-Age=2587680", "over=1; Max-Age=2587681"), entry("", "lost=1"),
    ]
    (d / "site.har").write_text(json.dumps({"log": {"version": "1.2", "entries": entries}}))
    (d / "other.har").write_text(json.dumps({"log": {"entries": [entry("https://a.lone.example/")]}}))
    cookie = lambda n, dom, e: {"name": n, "domain": dom, "expires": e, "third_party": True}
    at = 1782900000.0
    store = [cookie("uid", ".follow.net", at + 86400 * 365), cookie("js", ".follow.net", at + 86400 * 90), cookie("near", ".follow.net", at + 86400 * 29.96), cookie("s", ".follow.net", -1)]
    (d / "site_telemetry.json").write_text(json.dumps({"meta": {"etld1": "shop.example", "captured_at": START}, "observed_behavior": {"cookies": {"total": 4, "all_cookies": store}}}))
    return str(d)


def test_evidence(spark, scans):
    tracking = spark.createDataFrame([("follow.net",), ("count.net",)], "domain string")
    reqs = evidence.requests(readers.har(spark, f"{scans}/*.har"))
    tele = readers.telemetry(spark, f"{scans}/*_telemetry.json")
    party = evidence.first_party(reqs, tele)
    assert {r.scan: r.first_party for r in party.collect()} == {"site": "shop.example", "other": "lone.example"}
    header, browser = evidence.header_cookie_events(reqs, party, tracking), evidence.browser_cookie_events(tele, party, tracking)
    assert {r.name for r in header.where("profiling").collect()} == {"uid", "cid", "over"}
    assert {r.name for r in browser.where("profiling").collect()} == {"uid", "js"}
    totals = evidence.entry_counts(readers.har(spark, f"{scans}/*.har"))
    row = evidence.assemble(reqs, party, header, browser, tracking, tele, totals).where("scan = 'site'").first()
    assert row.summary.asDict() == {"total_requests": 6, "third_party_domains_contacted": 3, "tracker_requests": 3, "set_cookie_events": 7, "pre_consent_profiling_cookies": 4, "fingerprinting_alarms": 0}
    assert row.third_party_domains == ["count.net", "follow.net", "plain.org"] and [c.name for c in row.js_set_profiling_cookies] == ["js"] and row.declared_vs_actual is None


# A capture whose results are known.
GOLDEN_START = "2026-07-12T10:00:00Z"


@pytest.fixture(scope="module")
def golden(spark, tmp_path_factory):
    """A capture with each case of the profiling rule, its evidence row with and without telemetry and declarations."""
    d = tmp_path_factory.mktemp("golden")
    year = "Mon, 12 Jul 2027 10:00:00 GMT"
    at = lambda url, *c: entry(url, *c) | {"startedDateTime": GOLDEN_START}
    entries = [
        at("https://www.example.com/", "sessionid=abc; Path=/"), at("https://ad.doubleclick.net/x", f"id=1; Domain=.doubleclick.net; Expires={year}"), at("https://www.facebook.net/tr", "fr=1; Max-Age=3600"),
        at("https://ib.adnxs.com/seg", "anj=1; Max-Age=31536000"), at("https://pixel.rubiconproject.com/p", f"rpx=1; Expires={year}"), at("https://m.stripe.com/6", "m=1; Max-Age=63072000"),
    ]
    (d / "example.har").write_text(json.dumps({"log": {"entries": entries}}))
    store = [("sessionid", "www.example.com", -1, False), ("_ga", ".google-analytics.com", 1815000000, True), ("id", ".doubleclick.net", 1846200000, True)]
    cookies = [dict(zip(("name", "domain", "expires", "third_party"), c)) for c in store]
    (d / "example_telemetry.json").write_text(json.dumps({
        "meta": {"url": "https://www.example.com", "final_url": "https://www.example.com/", "etld1": "example.com", "captured_at": GOLDEN_START},
        "observed_behavior": {"cookies": {"total": 3, "all_cookies": cookies}, "fingerprinting_traps": {"alarms_triggered": 1, "alarms": ["COMPLIANCE_ALARM: HTMLCanvasElement.toDataURL read"]}},
        "visual_evidence": {"interactable_elements": {"total": 9, "consent_related_count": 2}},
    }))
    tracking = trackers.builtin(spark)
    har, tele = readers.har(spark, f"{d}/*.har"), readers.telemetry(spark, f"{d}/*_telemetry.json")

    def row(tele, **more):
        reqs = evidence.requests(har)
        party = evidence.first_party(reqs, tele)
        return evidence.assemble(reqs, party, evidence.header_cookie_events(reqs, party, tracking), evidence.browser_cookie_events(tele, party, tracking), tracking, tele, evidence.entry_counts(har), **more)

    declared = spark.createDataFrame([("example", "doubleclick.net"), ("example", "www.facebook.net")], "scan string, domain string")
    names = spark.createDataFrame([("example", n) for n in ("id", "fr", "sessionid")], "scan string, name string")
    return row(tele, declared=declared, declared_cookies=names).cache(), row(tele.limit(0))


def test_golden_evidence(golden):
    with_telemetry, alone = (df.first() for df in golden)
    names = lambda cs: sorted(c.name for c in cs)
    assert with_telemetry.summary.pre_consent_profiling_cookies == 4 and alone.summary.pre_consent_profiling_cookies == 3
    assert names(with_telemetry.pre_consent_profiling_cookies) == ["anj", "id", "rpx"] and names(with_telemetry.js_set_profiling_cookies) == ["_ga"] and names(with_telemetry.other_third_party_cookies) == ["fr", "m"]
    dva = with_telemetry.declared_vs_actual
    assert dva.discrepancy_type == "neglect" and dva.undeclared_domains == ["adnxs.com", "rubiconproject.com", "stripe.com"] and dva.undeclared_cookies == ["_ga", "anj", "m", "rpx"]
    assert with_telemetry.summary.fingerprinting_alarms == 1 and with_telemetry.consent_ui_detected is True and with_telemetry.scanned_url == "https://www.example.com/"
    assert (alone.first_party, alone.consent_ui_detected, alone.declared_vs_actual, alone.fingerprinting_alarms) == ("example.com", None, None, [])


def test_evidence_texts(spark, golden):
    full, _ = golden
    dims = audit.dimensions(spark, ["pre_consent_tracking", "disclosure_of_third_parties", "right_to_withdraw", "tracking_without_consent"])
    got = {r.dimension: r for r in rendering.by_dimension(full, dims, most=2).collect()}
    assert "\npre_consent_profiling_cookies (3):" in got["pre_consent_tracking"].evidence_text and "  ... and 1 more" in got["pre_consent_tracking"].evidence_text
    assert "cookie '_ga' (google-analytics.com), lifetime " in got["pre_consent_tracking"].evidence_text
    assert '\ndeclared_vs_actual: {"declared_third_party_domains"' in got["disclosure_of_third_parties"].evidence_text
    assert got["right_to_withdraw"].evidence_text.endswith(rendering.NOT_APPLICABLE) and not got["right_to_withdraw"].has_events and got["tracking_without_consent"].has_events
    site = rendering.of_site(full, most=2).first().evidence_text
    assert "Third-party domains contacted: 5\n  - adnxs.com\n  - doubleclick.net\n  ... and 3 more." in site and "2 declared, 5 observed, 3 undeclared." in site and "POTENTIAL" in site
    seen = rendering.for_annotators(full).first().observed
    assert "profiling cookies before consent: 4" in seen and "  HTMLCanvasElement.toDataURL read" in seen and "not named in policy: 3" in seen
    empty = rendering.by_dimension(golden[1].where("false"), dims)
    assert empty.count() == 0


REPORT_ROW = "site string, dimension string, verdict string, score int, confidence double, policy_claim string, behavioral_evidence string, discrepancy_type string, breach struct<regulation:string,article:string,requirement_text:string>, retrieved_articles array<struct<regulation:string,article:string>>, rule_text string"


def report_rows(spark):
    law, got = "Consent shall be freely given and may be withdrawn at any time.", [("GDPR", "7"), ("PECR", "6")]
    policy = "We share data with partners such as doubleclick.net for advertising purposes."
    rows = [
        ("example.com", "fine", "FAIL", 20, 0.9, "We share data with partners", "ad.doubleclick.net set the cookie 'anj'; 5 third-party hosts", "contrary", ("GDPR", "Article 7(1)", "Consent shall be freely given"), got, law),
        ("example.com", "cited", "PARTIAL", 50, 0.9, None, "adnxs.com", None, ("GDPR", "9", None), got, law),
        ("example.com", "quoted", "PASS", 90, 0.9, "We never share anything with anybody at all", "navigator.getBattery", None, (None, None, "Something else entirely is written here"), got, law),
        ("example.com", "invented", "FAIL", 80, 0.9, None, "evil.test set 'nosuch' and 77 trackers", "neglect", (None, None, None), got, law),
        ("example.com", "silent", "NOT_ADDRESSED", 10, 0.9, None, None, None, (None, None, None), got, law),
        ("example.com", "old", "PASS", 70, 0.9, None, None, None, (None, None, None), None, None),
        ("example.com", "dry", "DRY_RUN", None, None, None, None, None, None, None, None),
        ("bare.test", "unread", "FAIL", 30, 0.9, "We keep data for a year", "bare.test", "neglect", (None, None, None), got, None),
    ]
    return spark.createDataFrame(rows, REPORT_ROW), spark.createDataFrame([("example.com", policy)], "site string, policy_text string")


def test_verification_end_to_end(spark, golden):
    rows, policies = report_rows(spark)
    known = verification.universe(golden[0]).withColumn("site", F.lit("example.com"))
    done = verification.verify(rows, known, policies)
    got = {r.dimension: r for r in done.collect()}
    assert set(got) == {"fine", "cited", "quoted", "invented", "silent", "old", "unread"}
    checks = lambda d: [got[d][c] for c in verification.CHECKS]
    assert checks("fine") == ["SUPPORTED"] * 5 and got["fine"].grounded and got["fine"].issues == []
    assert checks("cited") == ["UNSUPPORTED", "N/A", "N/A", "SUPPORTED", "SUPPORTED"] and got["cited"].issues[0].startswith("C1: cited GDPR Art 9")
    assert checks("quoted")[1:4] == ["UNSUPPORTED", "UNSUPPORTED", "SUPPORTED"] and [i[:2] for i in got["quoted"].issues] == ["C2", "C3"]
    assert [i.split("'")[1] for i in got["invented"].issues if i.startswith("C4")] == ["evil.test", "nosuch", "77"] and "C5: score outside its band" in got["invented"].issues
    assert got["silent"].issues == ["C5: not addressed, yet cited or scored"]
    assert got["old"].legacy and got["old"].grounded
    assert got["unread"].C3_policy_quote == "N/A" and got["unread"].issues == ["C3: policy text unavailable to the verifier, quote could not be checked", "C5: neglect without a policy"]
    of = {r.site: r for r in verification.summary(done).collect()}
    s = of["example.com"]
    assert (s.dimensions_checked, s.dimensions_verifiable, s.dimensions_fully_grounded, s.grounding_rate, s.grounding_rate_all, s.legacy_report) == (6, 5, 2, 0.2, 0.333, True)
    assert s.C1_citation.asDict() == {"supported": 1, "unsupported": 1, "na": 4} and sum(r.n for r in verification.tally(done).collect()) == 35
    assert verification.verify(rows, None, policies).count() == 7 and verification.verify(rows.limit(0), known, policies).count() == 0
    with pytest.raises(SystemExit):
        writers.gate(done.select(F.explode(F.array(*verification.CHECKS)).alias("status")))


def test_batch(spark, tmp_path):
    template = "Dimension {dim_id} ({law_refs}) {{as is}}\n{law_context}|{policy_context}|{evidence_context}"
    dims = audit.dimensions(spark, ["lawful_basis", "childrens_data"])
    texts = dims.select(F.lit("a.test").alias("scan"), "dimension", F.lit("seen {x}").alias("evidence_text"), F.lit(True).alias("has_events"))
    asked = audit.prompts(texts, spark.createDataFrame([("a.test", "policy")], "scan string, policy_text string"), spark.createDataFrame([("lawful_basis", "law")], "dimension string, law_text string"), dims, template)
    assert {r.prompt for r in asked.collect()} == {"Dimension lawful_basis (GDPR Art 6, 13(1)(c)) {as is}\nlaw|policy|seen {x}", "Dimension childrens_data (GDPR Art 8; DPDP §9) {as is}\n|policy|seen {x}"}
    answer = lambda ps: ['{"verdict": "FAIL", "score": 30}' if "lawful" in p else None for p in ps]
    scored = audit.score_with(asked, answer).withColumn("domain", F.col("scan"))
    assert {(r.dimension, r.verdict, r.score) for r in scored.collect()} == {("lawful_basis", "FAIL", 30), ("childrens_data", "ERROR", None)}
    with pytest.raises(KeyError):
        audit.dimensions(spark, ["no_such"])
    assert audit.dimensions(spark, behavioural_only=True).count() == 8
    sites = spark.createDataFrame([("a.test", "news", "IE"), ("b.test", "news", "IE"), ("c.test", "shop", "UK")], "domain string, sector string, jurisdiction string")
    health = spark.createDataFrame([("a.test", 50, 3, True), ("b.test", 2, 0, False)], "domain string, requests int, ui_elements int, healthy boolean")
    rates = spark.createDataFrame([("a.test", 0.5, 1)], "domain string, grounding_rate double, dimensions_with_issues bigint")
    records = audit.batch(sites, health, scored, rates, spark.createDataFrame([("a.test", 2)], "domain string, n_files bigint"))
    got = {r.domain: r for r in records.collect()}
    assert [got[d].status for d in ("a.test", "b.test", "c.test")] == ["ok", "blocked", "collector_failed"] and (got["a.test"].n_fail, got["a.test"].overall_score, got["b.test"].notes) == (1, 30, "2 requests, 0 UI elements")
    writers.batch_csv(records, f"{tmp_path}/csv")
    writers.batch_json(records, f"{tmp_path}/json")
    back = spark.read.option("header", True).csv(f"{tmp_path}/csv")
    assert back.columns == writers.BATCH_COLUMNS and back.count() == 3 and readers.records(spark, f"{tmp_path}/json/*.json").count() >= 1
    page = writers.batch_markdown(records, spark.createDataFrame([(0, "C4: domain 'x' not in telemetry")], "pos int, issue string")).first().value
    assert "3 sites attempted, 1 scored, 1 blocked, 1 failed. Capture failure rate: 33%." in page and "| news | 1 | 30.0 | 50.0 |" in page and "| fabricated | 1 |" in page


def test_capture_health(spark, tmp_path):
    ok = {"meta": {"url": "u"}, "observed_behavior": {"all_requests": [{"url": "x"}] * 10}, "visual_evidence": {"interactable_elements": {"total": 1}}}
    (tmp_path / "good_telemetry.json").write_text(json.dumps(ok))
    (tmp_path / "few_telemetry.json").write_text(json.dumps(ok | {"observed_behavior": {"all_requests": [{"url": "x"}] * 9}}))
    (tmp_path / "bad_telemetry.json").write_text("{not json")
    t = readers.telemetry(spark, f"{tmp_path}/*_telemetry.json")
    assert {r.scan: r.healthy for r in audit.capture_health(t).collect()} == {"good": True, "few": False, "bad": False}
    assert {r.scan: r.healthy for r in audit.capture_health(t, lenient=True).collect()}["bad"] is True


def test_ground_truth(spark):
    human = spark.createDataFrame([("a", "d1", "FAIL"), ("a", "d2", "PASS"), ("b", "d1", "PASS"), ("z", "d1", "PASS")], "domain string, dimension string, human string")
    system = spark.createDataFrame([("a", "d1", "FAIL"), ("a", "d2", "PARTIAL"), ("b", "d1", "PASS")], "domain string, dimension string, verdict string")
    joined = agreement.matched(human, system)
    assert {(r.domain, r.dimension): r.matched for r in joined.collect()} == {("a", "d1"): True, ("a", "d2"): True, ("b", "d1"): True, ("z", "d1"): False}
    text = writers.ground_truth_markdown(joined, ["PASS", "PARTIAL", "FAIL", "NOT_ADDRESSED"], ["FAIL", "PARTIAL"]).first().value
    assert "3 annotated judgements, exact agreement 2 (67%)" in text and "1 rows had no system verdict" in text and "| FAIL | 1 | 1 | 1.00 | 1.00 | 1.00 |" in text and "TP 1, FP 1, FN 0" in text and "| d1 | 2 | 100% | 1.00 |" in text


def test_policies(spark, tmp_path):
    files = spark.createDataFrame([("s", 1, "b.md", "two"), ("s", 0, "a.md", "x" * 10), ("t", 0, "n.md", None)], "site string, pos int, name string, text string")
    sites = spark.createDataFrame([("s",), ("t",), ("u",)], "site string")
    got = {r.site: r.policy_text for r in policies.policy_text(files, sites, most=4).collect()}
    assert got == {"s": "--- a.md ---\nxxxx\n[... truncated ...]\n\n--- b.md ---\ntwo", "t": "--- n.md ---\n", "u": policies.NO_POLICY}
    names = spark.createDataFrame([("a.test_privacy_policy.md",), ("a.test_cookie_policy.md",), ("host.test_privacy_policy.md",), ("other_cedar.test_terms_policy.md",), ("b.md",)], "file string")
    mapping = spark.createDataFrame([("b.test", "host.test"), ("a.test", "host.test"), ("c.test", "none.test")], "domain string, host string")
    domains = spark.createDataFrame([("a.test",), ("b.test",), ("www.cedar.test",), ("nothing.test",)], "domain string")
    assert {(r.domain, r.file, r.tier) for r in policies.find_policies(domains, names, mapping).collect()} == {
        ("a.test", "a.test_privacy_policy.md", 1), ("a.test", "a.test_cookie_policy.md", 1), ("b.test", "host.test_privacy_policy.md", 2), ("www.cedar.test", "other_cedar.test_terms_policy.md", 3),
    }


def test_choices_among_links_and_answers(spark):
    c = spark.createDataFrame([("other_policy", 0, "https://x/p", "About Us"), ("other_policy", 5, "https://x/p", "about us"), ("privacy_policy", 0, "https://x/about us", None), ("other_policy", 0, "https://x/q", None)], "category string, score int, href string, text string")
    assert [r[0] for r in c.select(policies.is_marketing(F.col("category"), F.col("score"), F.col("href"), F.col("text"))).collect()] == [True, False, False, False]
    links_ = [("k", "a.test", "https://a.test/terms", "x", 0), ("k", "a.test", "https://a.test/p", "Read the full text", 1), ("k", "a.test", "https://evil.org/full", "full detail", 2), ("k", "a.test", "https://a.test/login/full", "full", 3)]
    best = policies.best_deep_link(spark.createDataFrame(links_, "k string, host string, href string, text string, pos int"), ["k"], ["privacy"]).first()
    assert (best.href, best.score) == ("https://a.test/p", 50)
    r = spark.createDataFrame([("s", 0, "u0"), ("s", 1, "u1"), ("t", 0, "v0")], "scan string, pos int, url string")
    w = spark.createDataFrame([("s", "u1"), ("t", "v9")], "scan string, final_url string")
    assert {tuple(x) for x in policies.main_response(r, w).collect()} == {("s", "u1", "final_url"), ("t", "v0", "fallback_first_document")}
    raw = spark.createDataFrame([('```json\n{"privacy_policy": {"url": "u"}, "cookie_policy": {"reason": "none"}}\n```',), ("nonsense",)], "raw string")
    got = [x[0] for x in raw.select(policies.picked_urls(F.col("raw"))).collect()]
    assert {k: tuple(v) for k, v in got[0].items()} == {"privacy_policy": ("u", "")} and not got[1]
    raw = spark.createDataFrame([('{"privacy_policy": {"looks_correct": false, "reason": "r"}, "cookie_policy": "x"}',)], "raw string")
    assert {k: tuple(v) for k, v in raw.select(policies.checked_documents(F.col("raw"))).first()[0].items()} == {"privacy_policy": (False, "r")}
    section = "# P\n## Cookies\n" + "word " * 200 + "\n## Next\nz"
    both = spark.createDataFrame([(section, None), (section, "w " * 400), ("## Cookies\nshort", None)], "privacy string, cookie string")
    assert [x[0] is not None for x in both.select(policies.embedded_cookie_policy(F.col("privacy"), F.col("cookie"))).collect()] == [True, False, False]


def test_sitemaps_are_followed(spark):
    index = lambda *locs: "<sitemapindex>" + "".join(f"<sitemap><loc> {x} </loc></sitemap>" for x in locs) + "</sitemapindex>"
    urls = lambda *locs: "<urlset>" + "".join(f"<url><loc>{x}</loc></url>" for x in locs) + "</urlset>"
    bodies = spark.createDataFrame([("r", index("m", "d1")), ("m", urls("https://a.test/privacy", "https://evil.org/privacy", "https://a.test/shop")), ("d1", index("d2")), ("d2", index("d3")), ("d3", urls("https://a.test/privacy-deep"))], "url string, body string")
    roots = spark.createDataFrame([("a.test", "r")], "host string, sitemap string")
    assert [r.loc for r in readers.sitemap_pages(roots, bodies, ["privacy"]).collect()] == ["https://a.test/privacy"]
    assert {r.loc for r in readers.sitemap_pages(roots, bodies, ["privacy"], depth=3).collect()} == {"https://a.test/privacy", "https://a.test/privacy-deep"}
    robots = spark.createDataFrame([("https://a.test", "User-agent: *\nSitemap: https://a.test/s.xml\n"), ("https://b.test", "")], "origin string, body string")
    got = [r.sitemap for r in readers.robots_sitemaps(robots).collect()]
    assert got[0] == "https://a.test/s.xml" and len(got) == 5 and readers.sitemap_links(bodies, ["deep"]).count() == 1


def test_tracker_lists(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"categories": {"Content": [{"S": {"https://s": ["both.net", "c.org"], "note": "text"}}], "Advertising": [{"T": {"https://t": ["both.net"]}}]}}))
    (tmp_path / "b.txt").write_text("# list\n\nboth.net\nsub.b.co.uk\n")
    a, b = trackers.list_a(readers.tracker_list_a(spark, f"{tmp_path}/a.json")), trackers.list_b(readers.tracker_list_b(spark, f"{tmp_path}/b.txt"))
    assert {r.domain: r.category for r in a.collect()} == {"both.net": "Advertising", "c.org": "Content"}
    assert {r.domain for r in b.collect()} == {"both.net", "b.co.uk"}
    own = trackers.builtin(spark)
    got = {(r.mode, r.domain) for r in trackers.tracker_domains(a, b, own).where("mode <> 'builtin'").collect()}
    assert got == {("intersection", "both.net"), ("single_a", "both.net"), ("single_b", "both.net"), ("single_b", "b.co.uk")}
    assert trackers.mode(a, b).first().mode == "intersection" and trackers.mode(a.limit(0), b.limit(0)).first().mode == "builtin"


def test_tracker_database(spark):
    p = spark.createDataFrame([("x", "advertising", ["x.net"]), ("y", "cdn", ["y.net"]), ("z", None, [])], "pattern string, category string, domains array<string>")
    d = spark.createDataFrame([("more.net", "x"), ("z.net", "z"), ("stray.net", "?")], "domain string, pattern string")
    assert [r.domain for r in trackers.tracker_database(p, d).collect()] == ["more.net", "stray.net", "x.net", "z.net"]


def test_agreement_on_one_class_and_on_nothing(spark):
    same = spark.createDataFrame([("PASS", "PASS")] * 3, "human string, system string")
    assert agreement.kappa(same, ["PASS", "FAIL"]).first().kappa == 1.0
    assert agreement.kappa(same.limit(0), ["PASS", "FAIL"]).first().kappa == 0.0
    assert agreement.prf(same, ["PASS", "FAIL"]).where("label = 'FAIL'").first().f1 == 0.0


def test_links(spark):
    c = spark.createDataFrame([("k", "/a", 5, 0), ("k", "/b", 9, 1), ("k", "/c", 9, 2)], "k string, href string, score int, pos int")
    best = links.best_and_others(c, ["k"]).first()
    assert (best.best, best.others) == ("/b", ["/c", "/a"])
    extra = spark.createDataFrame([("k", "/z", 0, 0), ("k", "/a", 0, 1), ("k", "/y", 0, 2)], "k string, href string, score int, pos int")
    order = [r.href for r in links.pooled(c, extra, ["k"], prepend=True).orderBy("src", "pos").collect()]
    assert order == ["/y", "/a", "/z", "/b", "/c"]


def test_post_filter_stays_above_the_ranking(spark):
    v = retrieval.with_norm(spark.createDataFrame([(i, [1.0, float(i)], i % 2) for i in range(6)], "chunk_id bigint, embedding array<double>, label int"))
    q = v.where("chunk_id = 0").withColumn("query_id", F.col("chunk_id"))
    got = retrieval.top_k(retrieval.similarities(q, v), 3).where("label = 0")
    assert [r.chunk_id for r in got.orderBy("rank").collect()] == [0, 2]
    plan = got._sc._jvm.PythonSQLUtils.explainString(got._jdf.queryExecution(), "simple")
    assert plan.index("label") < plan.index("Window")


def test_writers(spark, tmp_path):
    rows = spark.createDataFrame([("s", "d<1>", "FAIL", 10, 0), ("s", "d2", "NOT_ADDRESSED", None, 1), ("s", "d3", "PASS", 5, 2)], "site string, dimension string, verdict string, score int, pos int")
    page = writers.report_html(rows).first().value
    assert page.index("d3") < page.index("d&lt;1&gt;") < page.index("d2")
    writers.domain_list(spark.createDataFrame([("b",), ("a",)], "domain string"), f"{tmp_path}/list")
    assert [r.value for r in spark.read.text(f"{tmp_path}/list").collect()] == ["a", "b"]
    chunks = spark.createDataFrame([("GDPR", "7", "t"), ("GDPR", "7", "t"), ("PECR", "6", "u")], "regulation string, article string, text string")
    writers.append_chunks(chunks, None, f"{tmp_path}/chunks")
    writers.append_chunks(chunks, spark.read.parquet(f"{tmp_path}/chunks"), f"{tmp_path}/chunks")
    assert spark.read.parquet(f"{tmp_path}/chunks").count() == 2


def test_sites_and_policy_map(spark, tmp_path):
    (tmp_path / "sites.txt").write_text("# comment\nhttps://a.example, news , IE\nhttps://b.example\n")
    got = [tuple(r) for r in readers.sites(spark, f"{tmp_path}/sites.txt").orderBy("url").collect()]
    assert got == [("https://a.example", "news", "IE"), ("https://b.example", "unknown", "?")]
    (tmp_path / "map.json").write_text(json.dumps({"_comment": "x", "a.example": ["p.example", "q.example"]}))
    assert readers.policy_map(spark, f"{tmp_path}/map.json").count() == 2


def test_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"scan": "s", "url": "https://a.b.example/x", "ts": "2026-01-01T00:10:00Z"}\n' * 3)
    captures.run_available(captures.request_counts(spark, f"{tmp_path}/in"), f"{tmp_path}/out", f"{tmp_path}/ck")
    assert [(r.etld1, r.n) for r in spark.read.parquet(f"{tmp_path}/out").collect()] == [("b.example", 3)]


def test_readers_of_texts_and_reports(spark, tmp_path):
    (tmp_path / "law").mkdir()
    (tmp_path / "law" / "a.txt").write_text("Article 1\nText\n")
    (tmp_path / "law" / "b.pdf").write_bytes(b"%PDF fake")
    assert {r.file: r.text for r in readers.whole_texts(spark, f"{tmp_path}/law/*.txt").collect()} == {"a.txt": "Article 1\nText\n"}
    assert [tuple(r) for r in readers.pdf_files(spark, f"{tmp_path}/law/*.pdf", lambda b: b.decode().upper()).collect()] == [("b.pdf", "%PDF FAKE")]
    report = {"domain": "a.test", "scan_date": "2026-01-01", "overall_score": 40, "dimensions": [{"dimension": "d", "verdict": "FAIL", "score": 40}, {"dimension": "e", "verdict": "DRY_RUN"}]}
    (tmp_path / "old.json").write_text(json.dumps(report))
    (tmp_path / "new.json").write_text(json.dumps(report))
    os.utime(tmp_path / "old.json", (1, 1))
    got = readers.reports(spark, f"{tmp_path}/*.json").collect()
    assert len(got) == 2 and got[0].row.verdict == "FAIL" and got[0].overall_score == 40
    assert readers.newest(spark, f"{tmp_path}/*.json").first().file.endswith("new.json")
    (tmp_path / "sheet.csv").write_text('domain,dimension,legal_requirement,observed_behaviour,policy_excerpt,human_verdict,annotator_notes\na,d,"x, ""y""",o,p, fail ,n\nb,d,x,o,p,,n\nc,d,x,o,p,maybe,n\n')
    assert [(r.domain, r.human, r.legal_requirement) for r in readers.annotations(spark, f"{tmp_path}/sheet.csv", ["PASS", "FAIL"]).collect()] == [("a", "FAIL", 'x, "y"')]


def test_writers_of_evidence_and_policies(spark, golden, tmp_path):
    writers.json_rows(golden[0], f"{tmp_path}/ev", by=["first_party"])
    assert json.loads(spark.read.text(f"{tmp_path}/ev").first().value)["summary"]["pre_consent_profiling_cookies"] == 4
    p = spark.createDataFrame([("a.test/x", "privacy_policy", "https://u", "Title", "Body", None)], "domain string, category string, url string, title string, body string, effective_date string")
    md = writers.policy_markdown(p).first()
    assert md.file == "a.test_x_privacy_policy.md" and md.value.startswith("---\ntitle: Title\nurl: https://u\n") and md.value.endswith("---\n\nBody")
    assert writers.policy_index(p).first().documents[0].title == "Title"
    rows = spark.createDataFrame([("a", "d", "law", 'saw "it"', "says", "FAIL")], "domain string, dimension string, legal_requirement string, observed_behaviour string, policy_excerpt string, verdict string")
    writers.annotation_sheet(rows, f"{tmp_path}/sheet")
    sheet = "\n".join(r.value for r in spark.read.text(f"{tmp_path}/sheet").collect())
    assert "FAIL" not in sheet and '"saw ""it"""' in sheet
    done = spark.createDataFrame([("a", "d")], "domain string, dimension string")
    assert writers.new_only(rows, done, ["domain", "dimension"]).count() == 0
    page = writers.report_html(spark.createDataFrame([("example", "d", "NOT_ADDRESSED", None, 0, 0.5, "neglect", "<b>")], "site string, dimension string, verdict string, score int, pos int, confidence double, discrepancy_type string, policy_claim string"), golden[0]).first().value
    assert "confidence: 50%" in page and "Neglect: observed" in page and "&lt;b&gt;" in page and "profiling cookies (4)" in page and "NOT ADDRESSED" in page


def test_network_and_payload(spark, golden, tmp_path):
    requests = spark.createDataFrame([("s", "b.net", "POST", True), ("s", "a.net", "get", True), ("s", "b.net", "GET", True), ("s", "own", "POST", False), ("s", None, "GET", None), ("t", "own", "GET", False)], "scan string, domain string, method string, third_party boolean")
    assert {r.scan: (r.total, r.third_party, r.third_party_posts, r.third_party_domains) for r in evidence.network_summary(requests).collect()} == {"s": (5, 3, 1, ["a.net", "b.net"]), "t": (1, 0, 0, [])}
    (tmp_path / "x_telemetry.json").write_text(json.dumps({"meta": {"url": "u"}, "declared_vs_observed": {"policy_links": [{"text": "t", "href": "/p"}], "meta_tags": [{"name": "n", "content": "c"}]}, "observed_behavior": {"cookies": {"total": 3, "all_cookies": [{"name": "secret"}]}}}))
    t = readers.telemetry(spark, f"{tmp_path}/*_telemetry.json")
    full, short = (json.loads(policies.compact_telemetry(t, with_tags=w).first().payload) for w in (True, False))
    assert full["declared_vs_observed"]["meta_tags"] and full["observed_behavior"]["cookies"] == {"total": 3} and "secret" not in str(full) and "meta_tags" not in short["declared_vs_observed"]
    assert policies.compact_text(F.lit("x")) is not None and spark.range(1).select(policies.compact_text(F.repeat(F.lit("x"), 50_000)).alias("t")).first().t == "x" * 40_000
