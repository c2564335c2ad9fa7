"""Edge cases of column expressions, on small tables of our own."""

import difflib
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from attestry.functions import cookies as C
from attestry.functions import html as H
from attestry.functions import numbers as N
from attestry.functions import text as X
from attestry.functions import urls as U
from attestry.functions.fuzzy import best_excerpt, best_ratio
from attestry.operators import grounding, links, retrieval, verdicts


def one(spark, column, **values):
    schema = ", ".join(f"{k} {'string' if isinstance(v, str) or v is None else 'double' if isinstance(v, float) else 'boolean' if isinstance(v, bool) else 'bigint'}" for k, v in values.items()) or "x int"
    return spark.createDataFrame([tuple(values.values()) or (1,)], schema).select(column.alias("r")).first()["r"]


@pytest.mark.parametrize("host, want", [("a.b.co.uk", "b.co.uk"), ("co.uk", "co.uk"), (".Ads.Example.COM", "example.com"), ("localhost", "localhost"), ("", ""), (None, ""), ("x.api.eu.com", "api.eu.com")])
def test_etld1(spark, host, want):
    assert one(spark, U.etld1(F.col("h")), h=host) == want


def test_the_two_registrable_domains_differ(spark):
    assert one(spark, U.root_domain(F.col("h")), h="www.shop.co.uk") == "co.uk"
    assert one(spark, U.etld1(F.col("h")), h="www.shop.co.uk") == "shop.co.uk"


def test_ports_stay_only_when_asked_for(spark):
    assert one(spark, U.url_host(F.col("u")), u="https://h.example:8443/x") == "h.example"
    assert one(spark, U.url_host(F.col("u"), strict_compat=True), u="https://h.example:8443/x") == "h.example:8443"


@pytest.mark.parametrize("url, score", [("https://x.org/privacy-policy", 10 + 30), ("https://x.org/en/privacy", 15 + 20), ("https://search.x.org/terms", 20), ("https://x.org/about/settings", -5)])
def test_score_url(spark, url, score):
    assert one(spark, U.score_url(F.col("u")), u=url) == score


def test_management_pages_are_no_policies(spark):
    assert one(spark, U.classify_policy(F.col("u"), F.lit("")), u="https://x.org/privacy/cookie_settings/") == "other_policy"
    assert one(spark, U.classify_policy(F.col("u"), F.lit("Cookie Policy")), u="https://x.org/c") == "cookie_policy"


def test_trust_is_of_whole_hosts(spark):
    trusted = lambda p, h: one(spark, U.is_trusted(F.col("p"), F.col("h")), p=p, h=h)
    assert not trusted("bbc.co.uk", "evil.co.uk") and trusted("bbc.co.uk", "news.bbc.co.uk") and trusted("www.BBC.co.uk", "bbc.co.uk")
    assert trusted("facebook.com", "about.fb.com") and trusted("www.instagram.com", "privacycenter.facebook.com") and not trusted("meta.com", "privacycenter.facebook.test")
    assert trusted("x.test", None) is False and trusted("x.test", "") is False


def test_trust_goes_both_ways(spark):
    assert one(spark, U.is_trusted(F.lit("example.com"), F.col("h")), h="www.example.com")
    assert one(spark, U.is_trusted(F.lit("google.com"), F.col("h")), h="policies.google.com")
    assert not one(spark, U.is_trusted(F.lit("example.com"), F.col("h")), h="other.org")


def test_set_cookie(spark):
    got = one(spark, C.parse_set_cookie(F.col("c")), c="id=a=b; Path=/x; Secure; path=/y; Max-Age=10")
    assert (got.name, got.value) == ("id", "a=b")
    assert got.attributes == {"path": "/y", "secure": None, "max-age": "10"}


START = "2026-07-01T00:00:00Z"


@pytest.mark.parametrize(
    "line, days",
    [
        ("a=1; Max-Age=86400; Expires=Wed, 01 Jul 2027 00:00:00 GMT", 1.0), ("a=1; Max-Age=abc; Expires=Wed, 01 Jul 2027 00:00:00 GMT", None), ("a=1", None),
        ("a=1; Expires=Sat, 11 Jul 2026 00:00:00 GMT", 10.0), ("a=1; Expires=Fri, 11-Jul-2026 12:00:00 GMT", 10.5), ("a=1; Expires=nonsense", None),
    ],
)
def test_header_lifetime(spark, line, days):
    got = one(spark, C.header_lifetime_days(C.parse_set_cookie(F.col("c"))["attributes"], F.to_timestamp(F.col("s"))), c=line, s=START)
    assert got == pytest.approx(days) if days is not None else got is None


def test_thirty_days_are_tested_rounded_for_headers_only(spark):
    days = [2587680 / 86400, 2587681 / 86400, 29.96, 30.0]
    df = spark.createDataFrame([(x,) for x in days], "d double")
    got = df.select(C.long_lived_header(F.col("d")).alias("h"), C.long_lived_browser(F.col("d")).alias("b")).collect()
    assert [r.h for r in got] == [False, True, True, True] and [r.b for r in got] == [False, False, False, True]


def test_chunks(spark):
    long = "word " * 40
    t = f"Preamble that is lost.\nArticle 7\n{long}\nArticle 8\nshort\n6.—(1) {long}\n1798.100. {long}"
    got = one(spark, X.legal_units(F.col("t")), t=t)
    assert [u.number for u in got] == ["7", "6", "1798.100"]
    plain = one(spark, X.legal_units(F.col("t")), t="one\n\ntwo\n\n\n")
    assert [(u.number, u.text) for u in plain] == [("1", "one"), ("2", "two")]


def test_first_requirement_type_counts(spark):
    assert one(spark, X.requirement_type(F.col("t")), t="A child may not consent to a cookie") == "cookies"
    assert one(spark, X.requirement_type(F.col("t")), t="The agreement") == "consent"
    assert one(spark, X.requirement_type(F.col("t")), t="Bookkeeping") == "retention"


def test_norm(spark):
    assert one(spark, X.norm(F.col("t")), t=" “A”  b —\n C’s ") == "\"a\" b - c's"


@pytest.mark.parametrize(
    "quote, status",
    [("", "N/A"), ("too short", "N/A"), ("personal data are kept", "SUPPORTED"), ("personal data are … longer than needed", "SUPPORTED"), ("the personal data are kapt no longer", "SUPPORTED"), ("entirely different words stand here", "UNSUPPORTED")],
)
def test_quotes(spark, quote, status):
    df = spark.createDataFrame([(quote, "The personal data are kept no longer than needed by anyone.")], "quote string, source string")
    assert grounding.quote_checks(df).first()["status"] == status


def test_ratio_ends_at_the_first_accepted_window():
    assert best_ratio("abcdefgh", "xxabcdefghxx") == 1.0
    assert best_ratio("abcdefgh", "zzzzzzzz") == 0.0


def test_law_references_stop_at_the_number_after_the_name(spark):
    got = one(spark, X.law_references(F.col("t")), t="GDPR Art 7(1), 7(2); EPRIVACY-IE Reg 5; DPDP §9")
    assert [(r.regulation, r.article) for r in got] == [("GDPR", "7"), ("EPRIVACY-IE", "5"), ("DPDP", "9")]


@pytest.mark.parametrize("text, want", [("Last updated: 1 January 2024", "1 January 2024"), ("Effective date – 2024-01-02", "2024-01-02"), ("Version 1.2", "1.2"), ("nothing", None)])
def test_effective_date(spark, text, want):
    assert one(spark, X.effective_date(F.col("t")), t=text) == want


def test_blocks_compare_with_the_last_three_kept(spark):
    a, b = "x" * 40, "This is a sentence that is long enough."
    blocks = F.array(*map(F.lit, ["hi", b, "hi", b.upper(), a, "c" * 31, "d" * 31, "e" * 31, a]))
    assert one(spark, X.dedupe_blocks(blocks)) == ["hi", b, "hi", a, "c" * 31, "d" * 31, "e" * 31, a]


def test_blocks_of_any_script_and_blank_ones(spark):
    one_, two = "これは十分に長い日本語の段落であり、三十文字を超えているはずです。", "こちらは別の日本語の段落であり、同じく三十文字を超えているはずです。"
    blocks = F.array(*map(F.lit, [one_, "  ", two, one_ + "!", "", "-" * 40]))
    assert one(spark, X.dedupe_blocks(blocks)) == [one_, two]


def test_excerpt_prefers_prose():
    text = "[consent](#a) [x](b)\n- consent list\n" + "y " * 500 + "We ask for consent. You may say no. You may change it. "
    assert best_excerpt(text, ["consent"], 120, 20).endswith("You may change it.")
    assert best_excerpt("abc", ["zzz"]) == "abc"


@pytest.mark.parametrize(
    "raw, want",
    [
        ('{"verdict": "PASS", "score": 33.9}', ("PASS", 33, 0.5)), ('{"verdict": "FAIL", "score": "33.9", "confidence": 0.2}', ("FAIL", None, 0.2)), ('{"verdict": "pass", "score": "34"}', ("PARTIAL", 34, 0.5)), ('{"verdict": "NOT_ADDRESSED", "score": 5, "confidence": 7.5}', ("NOT_ADDRESSED", 5, 1.0)),
        ('{"verdict": "PASS", "score": true, "confidence": "-2"}', ("PASS", 1, 0.0)), ('{"verdict": "PASS", "score": [1], "confidence": "x"}', ("PASS", None, 0.5)), ('{"verdict": "PASS", "score": " 4_2 "}', ("PASS", 42, 0.5)), ('{"verdict": 5', ("ERROR", None, 0.0)),
        ('{"verdict": "odd", "score": 120}', ("PARTIAL", 100, 0.5)), ("no json", ("ERROR", None, 0.0)), ('```json\n{"verdict": "FAIL", "score": -3}\n```', ("FAIL", 0, 0.5)), (None, ("ERROR", None, 0.0)), ("[1]", ("ERROR", None, 0.0)),
    ],
)
def test_responses(spark, raw, want):
    got = one(spark, verdicts.parse_response(F.col("r")), r=raw)
    assert (got.verdict, got.score, got.confidence) == want


def test_the_overall_score_rounds_half_to_even(spark):
    rows = [("a", "low", "PASS", 26), ("a", "low", "FAIL", 27), ("b", "critical", "PASS", 90), ("b", "low", "ERROR", None), ("c", "low", "NOT_ADDRESSED", None)]
    got = {r.site: (r.overall_score, r.overall_verdict) for r in verdicts.overall(spark.createDataFrame(rows, "site string, severity string, verdict string, score int")).collect()}
    assert got == {"a": (26, "POTENTIAL_NON_COMPLIANCE"), "b": (90, "LIKELY_COMPLIANT"), "c": (None, "INSUFFICIENT_DATA")}


def test_behaviour_claims(spark):
    args = (F.col("c"), F.array(F.lit("tracker.net")), F.array(F.lit("_ga")), F.array(F.lit(3)), F.lit("raw text with odd_name"))
    check = lambda c: one(spark, grounding.behaviour_issues(*args), c=c)
    assert check("ads.tracker.net set '_ga', 'odd_name' among 3 cookies via navigator.getBattery") == []
    assert check("made.up.org set 'nope' among 17 cookies") == ["domain 'made.up.org' not in telemetry", "cookie 'nope' not in telemetry", "count '17' not corroborated by telemetry"]


def test_citations(spark):
    got = lambda a, r: one(spark, grounding.citation_status(F.col("a"), F.col("r"), F.array(F.struct(F.lit("GDPR").alias("regulation"), F.lit("13").alias("article")))), a=a, r=r)
    assert [got("Article 13(1)(e)", "gdpr"), got("13", None), got("14", "GDPR"), got(None, "GDPR")] == ["SUPPORTED", "SUPPORTED", "UNSUPPORTED", "N/A"]


def test_html():
    html = '<nav><a href="/a">Menu</a></nav><main><h2 id="c">Cookies</h2><p>We <b>use</b> <a href="/p">them</a>.<ul><li>one<li>two</ul><table><tr><th>a</th></tr><tr><td>1</td></tr></table><h2>Next</h2><p>x</main>'
    assert H.markdown_of(html).split("\n\n") == ["## Cookies", "We **use** [them](/p) .", "- one\n- two", "| a |\n| --- |\n| 1 |", "## Next", "x"]
    assert [x["href"] for x in H.links_of(html)] == ["/a", "/p"]
    assert "Menu" not in H.text_of(html) and H.section_of(html, "c").startswith("Cookies\nWe use them")
    assert H.markdown_of(None) == "" and H.text_of("") == ""


@pytest.mark.parametrize("text, days", [("Sat, 11 Jul 2026 00:00:00 GMT", 10.0), ("11 Jul 2026 00:00:00 +0200", 10 - 2 / 24), ("Sat, 11 Jul 26 12:00:00", 10.5), ("tomorrow", None), (None, None)])
def test_odd_cookie_dates(spark, text, days):
    got = one(spark, C.cookie_expires(F.col("t")), t=text)
    start = datetime(2026, 7, 1, tzinfo=timezone.utc)
    assert got is None if days is None else (got.replace(tzinfo=timezone.utc) - start).total_seconds() / 86400 == pytest.approx(days)


def test_deep_pages_are_read():
    deep = "<div>" * 3000 + "x <b>y</b>" + "</div>" * 3000
    assert H.text_of(deep) == "x\ny" and H.markdown_of(deep) == "x **y**" and H.section_of(deep, "a") == "" and H.links_of(deep) == []
    assert H.markdown_of("<b>" * 2000 + "z" + "</b>" * 2000).count("*") == 8000
    assert H.markdown_of("<form><p>Agree</form><footer>short</footer><table><tr><th>a<th>b<tr><td>1<td>2</table>") == "Agree\n\n| a | b |\n| --- | --- |\n| 1 | 2 |"
    long = "word " * 300
    assert H.markdown_of(f"<nav>{long}</nav>") == long.strip() and H.markdown_of("<nav>Menu</nav>") == ""


def test_html_columns(spark):
    html = '<meta name="robots" content="no"><meta property="og:t" content="T"><meta charset="u"><h2 id="a">Head</h2><p>body<h2>Next</h2><a href="/x">link</a>'
    row = spark.createDataFrame([(html,), (None,)], "html string").select(H.html_text("html").alias("t"), H.html_links("html").alias("l"), H.html_section("html", F.lit("a")).alias("s"), H.html_meta("html").alias("m")).collect()
    assert row[0].t == "Head\nbody\nNext\nlink" and [tuple(x) for x in row[0].l] == [("/x", "link")] and row[0].s == "Head\nbody" and [tuple(x) for x in row[0].m] == [("robots", "no"), ("og:t", "T")]
    assert (row[1].t, row[1].l, row[1].s, row[1].m) == ("", [], "", [])


def test_url_helpers(spark):
    assert [one(spark, U.is_third_party(F.col("h"), F.lit("a.test")), h=h) for h in ("x.a.test", "b.test", "", None)] == [False, True, False, False]
    score = lambda url, kind, source: one(spark, U.candidate_score(F.lit(url), F.lit(kind), F.lit(source)))
    assert score("https://x.org/p#cookie", "cookie_policy", "crawl") == 100 and score("https://x.org/p#cookie", "cookie_policy", "wellknown") == -1 and score("https://x.org/p", "other_policy", "consent_popup") == 200
    assert one(spark, U.safe_filename(F.col("n")), n="a b/c.md") == "a_b_c.md"
    assert one(spark, U.laws_of(F.lit("UK"))) == ["GDPR", "PECR"] and one(spark, U.laws_of(F.lit("?"), F.lit("https://x.in/a"))) == ["GDPR", "DPDP"]
    have, lack = U.security_headers(F.create_map(F.lit("X-Frame-Options"), F.lit("DENY"), F.lit("Server"), F.lit("s")))
    assert one(spark, have) == {"X-Frame-Options": "DENY"} and "content-security-policy" in one(spark, lack) and "x-frame-options" not in one(spark, lack)


def test_text_helpers(spark):
    assert one(spark, X.fix_pdf_breaks(F.col("t")), t="the data,\nsubject. Article 7 says") == "the data, subject.\n\nArticle 7 says"
    assert one(spark, X.fix_html_breaks(F.col("t")), t="a  b\n \n\nArticle\n7\nText") == "a b\n\nArticle 7\nText"
    assert one(spark, X.headings_of_plain(F.col("t")), t="PRIVACY\nwe keep data for a while\nYour Rights") == "\n## PRIVACY\n\nwe keep data for a while\n\n## Your Rights\n"
    assert one(spark, X.prose_score(F.col("t")), t="One. Two. [a](#b)\n- x") == 4 - 6 - 1
    assert one(spark, X.front_matter_body(F.col("t")), t="---\na: b\n---\n\nbody --- rest") == "body --- rest" and one(spark, X.front_matter_body(F.col("t")), t="no matter") == "no matter"
    assert one(spark, grounding.behaviour_status(F.col("c"), F.array().cast("array<string>"), F.array(F.lit("a.net")), F.array(F.lit("_ga"))), c="sets '_ga'") == "SUPPORTED"


def test_numbers_round_as_python_does(spark):
    values = [2.675, 0.5, 1.5, -0.125, None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select(N.py_round(F.col("v"), 2).alias("r"), N.py_format(F.col("v"), ".0%").alias("p")).collect()
    assert [r.r for r in got] == [None if v is None else round(v, 2) for v in values] and [r.p for r in got] == ["—" if v is None else f"{v:.0%}" for v in values]


@pytest.mark.parametrize("quote", ["the personal … data are kapt no longer than it is needed", "personal data are kept ... no longxr than needed by anyone"])
def test_fuzzy_quotes_are_compared_without_ellipses(spark, quote):
    source = "The personal data are kept no longer than needed by anyone."
    got = grounding.quote_checks(spark.createDataFrame([(quote, source)], "quote string, source string")).first()
    plain, low = " ".join(quote.replace("...", " ").replace("…", " ").split()).lower(), source.lower()
    windows = [difflib.SequenceMatcher(None, plain, low[i : i + len(plain)]).ratio() for i in range(0, max(1, len(low) - len(plain) + 1), max(1, len(plain) // 4))]
    first = next((w for w in windows if w >= 0.9), max(windows))
    assert got.ratio == pytest.approx(first, abs=1e-3)


def test_quotes_meet_their_texts(spark):
    texts = ["the quick brown fox jumps over it", "quick brown foxes", "", None, "x quick brown fox"]
    quotes = ["quick brown fox", "ick brown fo", "fox", "", "brown fox jumps", None, "lazy dog sleeps", "fox"]
    t = spark.createDataFrame(list(enumerate(texts)), "text_id int, text string")
    q = spark.createDataFrame(list(enumerate(quotes)), "quote_id int, quote string")
    want = {(i, j) for i, a in enumerate(quotes) for j, b in enumerate(texts) if a is not None and b is not None and a in b}
    assert {tuple(r) for r in grounding.containing(q, t).collect()} == want and grounding.containing(q.limit(0), t).count() == 0


def test_chosen_candidates(spark):
    c = spark.createDataFrame([("k", "/a", 5, "crawl")], "k string, href string, score int, source string")
    picked = spark.createDataFrame([("k", "/a"), ("k", "/made-up")], "k string, href string")
    assert {(r.href, r.score, r.source) for r in links.choose(picked, c, ["k"]).collect()} == {("/a", 5, "crawl"), ("/made-up", 0, "choice")}


def test_law_context(spark):
    c = spark.createDataFrame([("q", 2, "PECR", "6", "b"), ("q", 1, "GDPR", "7", "a")], "query_id string, rank int, regulation string, article string, text string")
    q = spark.createDataFrame([("q",), ("none",)], "query_id string")
    assert {r.query_id: r.context for r in retrieval.render(c, queries=q).collect()} == {"q": "[GDPR — Article 7]\na\n\n[PECR — Article 6]\nb", "none": retrieval.NO_LAW}


def test_epoch_lifetime(spark):
    at = datetime(2026, 7, 1, tzinfo=timezone.utc).timestamp()
    for expires, days in ((at + 86400 * 3, 3.0), (-1.0, None), (0.0, None)):
        got = one(spark, C.epoch_lifetime_days(F.col("e"), F.to_timestamp(F.col("s"))), e=expires, s=START)
        assert got == pytest.approx(days) if days else got is None


def test_norm_unifies_each_mark(spark):
    marks = "‘’“”–—\u00a0"
    for text in (marks, "x".join(marks), f"A{marks[-1]}  B{marks} ", " ", "", "Ünï – “Cö” 𝒳—"):
        unified = text.translate(str.maketrans(marks, "''\"\"-- "))
        want = " ".join(unified.split()).lower()
        assert one(spark, X.norm(F.col("t")), t=text) == want
