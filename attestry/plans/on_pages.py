"""Queries over pages: URLs, hosts, links and HTML.

Pages stand for captured requests and documents. The vocabularies are
stand-ins, as the tables hold invented words.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import html as H
from attestry.functions import text as X
from attestry.functions import urls as U
from attestry.operators import grounding, links, policies
from attestry.plans.registry import query, table

FIRST_PARTY = "example.com"
#: Two-label suffixes that make three-label domains of the tables' hosts.
SUFFIXES = ["example.net", "co.uk"]
DIRECT = [("privacy_policy", ["/en/1", "/en/2"]), ("cookie_policy", ["/fr/", "/de/"]), ("terms_and_conditions", ["ref=x"])]
WEAK = ["/es/", "99"]
KEYWORDS = [("privacy_policy", ["blog", "top"]), ("other_policy", ["utm_source"])]
LINK_WORDS = [("privacy_policy", ["the", "que"]), ("other_policy", ["und"])]
ANCHOR = r'(?is)<a\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>'

HOST_SQL = "lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1))"
PATH_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1)"
H_SQL = f"h AS (SELECT page_id, url, html, {HOST_SQL} AS host, {PATH_SQL} AS path, string_split({HOST_SQL}, '.') AS l FROM pages)"
ETLD1_SQL = "CASE WHEN len(l) >= 3 AND array_to_string(l[-2:], '.') IN ('example.net', 'co.uk') THEN array_to_string(l[-3:], '.') ELSE array_to_string(l[-2:], '.') END"


def hosts(spark, d) -> DataFrame:
    return table(spark, d, "pages").withColumn("host", U.url_host(F.col("url")))


@query(f"WITH {H_SQL} SELECT page_id, {ETLD1_SQL} AS etld1 FROM h")
def q_etld1(spark, d):
    return hosts(spark, d).select("page_id", U.etld1(F.col("host"), SUFFIXES).alias("etld1"))


@query(f"WITH {H_SQL}, r AS (SELECT page_id, string_split(regexp_replace(host, '^www\\.', ''), '.') AS b, {ETLD1_SQL} AS etld1 FROM h) SELECT page_id, array_to_string(b[-2:], '.') AS root_domain, array_to_string(b[-2:], '.') <> etld1 AS differs FROM r")
def q_root_domain(spark, d):
    root = U.root_domain(F.col("host"))
    return hosts(spark, d).select("page_id", root.alias("root_domain"), (root != U.etld1(F.col("host"), SUFFIXES)).alias("differs"))


@query(f"WITH {H_SQL} SELECT page_id, host, path, CASE WHEN contains(url, '#') THEN regexp_extract(url, '#(.*)$', 1) ELSE '' END AS fragment, starts_with(url, 'https://') AS https FROM h")
def q_url_parts(spark, d):
    u = F.col("url")
    return hosts(spark, d).select("page_id", "host", U.url_path(u).alias("path"), U.url_fragment(u).alias("fragment"), U.is_https(u).alias("https"))


@query(f"WITH {H_SQL}, e AS (SELECT {ETLD1_SQL} AS etld1 FROM h WHERE host <> '') SELECT etld1, count(*) AS n FROM e WHERE etld1 <> 'example.com' GROUP BY 1")
def q_third_party_requests(spark, d):
    third = hosts(spark, d).where(U.is_third_party(F.col("host"), F.lit(FIRST_PARTY), SUFFIXES))
    return third.groupBy(U.etld1(F.col("host"), SUFFIXES).alias("etld1")).agg(F.count("*").alias("n"))


_ROOT = "array_to_string(string_split(regexp_replace({0}, '^www\\.', ''), '.')[-2:], '.')"


@query(f"""WITH {H_SQL}, p AS (SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'example.com' WHEN 1 THEN 'www.example.com' ELSE 'shop.co.uk' END AS a, CASE page_id % 8 WHEN 0 THEN 'evil.co.uk' WHEN 1 THEN 'UK' WHEN 2 THEN '' ELSE host END AS b FROM h),
l AS (SELECT page_id, a, lower(b) AS b FROM p) SELECT page_id, b <> '' AND (contains(a, b) OR contains(b, a) OR ({_ROOT.format('a')} = 'example.com' AND (b IN ('example.org', 'cdn.example.net') OR {_ROOT.format('b')} IN ('example.org', 'cdn.example.net')))) AS trusted FROM l""")
def q_trusted_domain(spark, d):
    kin = {"example.com": ["example.org", "cdn.example.net"]}
    i = F.col("page_id")
    primary = F.when(i % 3 == 0, FIRST_PARTY).when(i % 3 == 1, "www.example.com").otherwise("shop.co.uk")
    candidate = F.when(i % 8 == 0, "evil.co.uk").when(i % 8 == 1, "UK").when(i % 8 == 2, "").otherwise(F.col("host"))
    return hosts(spark, d).select("page_id", U.is_trusted(primary, candidate, kin).alias("trusted"))


SCORE_SQL = """(CASE WHEN regexp_matches(lower(url), '/en/1|/en/2') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(url), '/fr/|/de/') THEN 10 ELSE 0 END
 + CASE WHEN contains(lower(url), 'ref=x') THEN 10 ELSE 0 END + CASE WHEN regexp_matches(lower(path), '/es/|99') THEN -5 ELSE 0 END
 + CASE WHEN regexp_matches(lower(path), '/(en|en-us|en-gb)(/|$)') AND regexp_matches(lower(path), '7|8') THEN 15 ELSE 0 END
 + CASE WHEN regexp_matches(rtrim(lower(path), '/'), '(5|\\.html)$') THEN 20 ELSE 0 END
 + CASE WHEN regexp_matches(lower(url), '(blog.{0,9}example)|(th.{0,3}the)') THEN 30 ELSE 0 END)"""


def score():
    return U.score_url(F.col("url"), DIRECT, WEAK, ("5", ".html"), ["7", "8"], "(blog.{0,9}example)|(th.{0,3}the)")


@query(f"WITH {H_SQL} SELECT page_id, {SCORE_SQL} AS score FROM h")
def q_score_url(spark, d):
    return table(spark, d, "pages").select("page_id", score().alias("score"))


KIND_SQL = """CASE WHEN regexp_matches(lower(url), 'm\\.|page=2') THEN 'other_policy' WHEN regexp_matches(lower(url), '/en/1|/en/2') THEN 'privacy_policy'
 WHEN regexp_matches(lower(url), '/fr/|/de/') THEN 'cookie_policy' WHEN contains(lower(url), 'ref=x') THEN 'terms_and_conditions'
 WHEN regexp_matches(lower(url), 'blog|top') THEN 'privacy_policy' ELSE 'other_policy' END"""


def kind():
    return U.classify_policy(F.col("url"), F.lit(""), ["m.", "page=2"], DIRECT, KEYWORDS)


@query(f"WITH {H_SQL} SELECT page_id, {KIND_SQL} AS kind, regexp_matches(lower(path), '/en/9|/de/') AS auth_like FROM h")
def q_classify_url(spark, d):
    return table(spark, d, "pages").select("page_id", kind().alias("kind"), U.is_auth_url(F.col("url"), ["/en/9", "/de/"]).alias("auth_like"))


def anchors(spark, d) -> DataFrame:
    """(page_id, pos, href, label, host) of the links in a page's markup."""
    both = F.arrays_zip(F.regexp_extract_all("html", F.lit(ANCHOR), 1).alias("href"), F.regexp_extract_all("html", F.lit(ANCHOR), 2).alias("label"))
    return hosts(spark, d).select("page_id", "url", "host", F.posexplode(both).alias("pos", "a")).select("page_id", "url", "host", "pos", "a.href", "a.label")


A_SQL = f"""{H_SQL}, z AS (SELECT page_id, url, host, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 1) AS hr, regexp_extract_all(html, '(?is)<a\\s[^>]*?href="([^"]*)"[^>]*>(.*?)</a>', 2) AS lb FROM h),
a AS (SELECT page_id, url, host, unnest(hr) AS href, unnest(lb) AS label, generate_subscripts(hr, 1) - 1 AS pos FROM z)"""


@query(f"WITH {A_SQL} SELECT page_id, count(*) AS links, count(*) FILTER (WHERE regexp_matches(lower(href || ' ' || label), 'the|que|und')) AS policy_links FROM a GROUP BY 1")
def q_policy_links(spark, d):
    return anchors(spark, d).groupBy("page_id").agg(F.count("*").alias("links"), F.count_if(U.is_policy_link(F.col("href"), F.col("label"), LINK_WORDS)).alias("policy_links"))


@query(f"WITH {A_SQL} SELECT page_id, pos, href, label, CASE WHEN starts_with(href, '/') THEN 'https://' || host || href WHEN starts_with(href, 'http') THEN href END AS absolute FROM a")
def q_page_links(spark, d):
    return anchors(spark, d).select("page_id", "pos", "href", "label", U.absolute_url(F.concat(F.lit("https://"), F.col("host")), F.col("href")).alias("absolute"))


@query(f"""WITH {H_SQL}, c AS (SELECT host, url, page_id, {SCORE_SQL} AS score FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY host ORDER BY score DESC, page_id) AS rk FROM c)
SELECT host, max(url) FILTER (WHERE rk = 1) AS best, max(score) FILTER (WHERE rk = 1) AS best_score, coalesce(string_agg(url, ' ' ORDER BY rk) FILTER (WHERE rk BETWEEN 2 AND 4), '') AS others FROM r GROUP BY host""")
def q_best_url(spark, d):
    c = hosts(spark, d).select("host", F.col("url").alias("href"), score().alias("score"), F.col("page_id").alias("pos"))
    return links.best_and_others(c, ["host"], most=3).select("host", "best", "best_score", F.array_join("others", " ").alias("others"))


@query(f"WITH {H_SQL} SELECT host, arg_min(url, page_id) FILTER (WHERE length(html) > 3000) AS first_url, count(*) AS tried FROM h GROUP BY host")
def q_first_success(spark, d):
    c = hosts(spark, d).select("host", F.col("url").alias("href"), F.col("page_id").alias("pos"), (F.length("html") > 3000).alias("ok"))
    return links.first_success(c, ["host"]).select("host", F.col("href").alias("first_url"), "tried")


@query(f"WITH {A_SQL} SELECT page_id, count(*) AS links FROM a WHERE regexp_matches(lower(href || ' ' || label), 'e') GROUP BY 1 HAVING count(*) > 5")
def q_hub_pages(spark, d):
    hit = U.is_policy_link(F.col("href"), F.col("label"), [("any", ["e"])])
    return links.hub_pages(anchors(spark, d), ["page_id"], hit)


@query(r"""WITH t AS (SELECT page_id, regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|noscript)[^>]*>.*?</(script|style|noscript)>', ' ', 'g'), '(?s)<!--.*?-->', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g') AS t FROM pages)
SELECT page_id, length(trim(regexp_replace(t, '[ \t\n\r]+', ' ', 'g'))) AS n_chars FROM t""")
def q_page_text(spark, d):
    return table(spark, d, "pages").select("page_id", F.length(X.dom_text(F.col("html"))).alias("n_chars"))


@query()
def q_page_markdown(spark, d):
    return table(spark, d, "pages").select("page_id", H.html_markdown("html").alias("markdown")).select("page_id", F.size(F.split("markdown", "\n\n")).alias("blocks"), F.md5("markdown").alias("digest"))


@query(r"""SELECT page_id, replace(replace(replace(replace(replace(regexp_extract(html, '(?is)<title>(.*?)</title>', 1), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') AS title FROM pages""")
def q_html_escape(spark, d):
    return table(spark, d, "pages").select("page_id", X.html_escape(F.regexp_extract("html", r"(?is)<title>(.*?)</title>", 1)).alias("title"))


KNOWN = ["example.com", "blog.example.org", "therin.example.net", "x.www.ththhe.example.com"]


@query("""WITH h AS (SELECT DISTINCT lower(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)) AS claim FROM pages), k AS (SELECT unnest(['example.com', 'blog.example.org', 'therin.example.net', 'x.www.ththhe.example.com']) AS domain)
SELECT claim, domain FROM h JOIN k ON claim = domain OR ends_with(claim, '.' || domain) OR ends_with(domain, '.' || claim)""")
def q_suffix_join(spark, d):
    known = spark.createDataFrame([(k,) for k in KNOWN], "domain string")
    return grounding.suffix_pairs(hosts(spark, d).select(F.col("host").alias("claim")).distinct(), known)


@query(f"""WITH {H_SQL}, e AS (SELECT {ETLD1_SQL} AS etld1, host FROM h) SELECT etld1, string_agg(DISTINCT host, ' ' ORDER BY host) AS hosts FROM e GROUP BY 1""")
def q_domain_sets(spark, d):
    # Hosts are deduplicated before they are gathered: the list is as long as a domain has hosts.
    e = hosts(spark, d).select(U.etld1(F.col("host"), SUFFIXES).alias("etld1"), "host").distinct()
    return e.groupBy("etld1").agg(F.array_join(F.sort_array(F.collect_list("host")), " ").alias("hosts"))


@query(f"""WITH {H_SQL}, c AS (SELECT host, path, url, page_id, CASE WHEN starts_with(url, 'https') THEN 0 ELSE 1 END AS src FROM h), r AS (SELECT *, row_number() OVER (PARTITION BY host, path ORDER BY src, page_id) AS rk FROM c) SELECT host, path, url, src FROM r WHERE rk = 1""")
def q_keep_first(spark, d):
    from attestry.operators.trackers import keep_first

    c = hosts(spark, d).select("host", U.url_path(F.col("url")).alias("path"), "url", "page_id", F.when(F.startswith("url", F.lit("https")), 0).otherwise(1).alias("src"))
    return keep_first(c, ["host", "path"], ["src", "page_id"]).select("host", "path", "url", "src")


_CLICK = "CASE page_id % 4 WHEN 0 THEN 'About Us' WHEN 1 THEN 'Learn more about cookies' WHEN 2 THEN 'Full text' ELSE 'other' END"


@query(f"""WITH {H_SQL}, c AS (SELECT page_id, {KIND_SQL} AS kind, {SCORE_SQL} AS score, {_CLICK} AS label, url FROM h) SELECT kind, count(*) AS candidates, count(*) FILTER (WHERE kind = 'other_policy' AND score = 0 AND regexp_matches(lower(url || ' ' || label), 'meta products|about us')) AS skipped FROM c GROUP BY 1""")
def q_skipped_candidates(spark, d):
    rows = table(spark, d, "pages").select(kind().alias("kind"), score().alias("score"), "url", F.expr(_CLICK).alias("label"))
    skip = policies.is_marketing(F.col("kind"), F.col("score"), F.col("url"), F.col("label"))
    return rows.groupBy("kind").agg(F.count("*").alias("candidates"), F.count_if(skip).alias("skipped"))


@query(f"""WITH {A_SQL} SELECT page_id, count(*) AS elements, count(*) FILTER (WHERE regexp_matches(lower(label), 'the|que|und')) AS consent_related FROM a GROUP BY 1""")
def q_consent_elements(spark, d):
    return anchors(spark, d).groupBy("page_id").agg(F.count("*").alias("elements"), F.count_if(X.is_consent_control(F.col("label"), ["the", "que", "und"])).alias("consent_related"))
