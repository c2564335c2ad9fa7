"""Queries that run the operators end to end on captures: each user's events stand for a scan's requests."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestry.functions import cookies as C
from attestry.functions import text as X
from attestry.functions import urls as U
from attestry.operators import audit, evidence, grounding, ordering, policies, rendering
from attestry.plans.on_events import events
from attestry.plans.on_orders import BAND_SQL, S_SQL, V_SQL, verdict_rows
from attestry.plans.registry import query, table
from attestry.sources.scratch import fresh_folder

TRACKERS = ["click.net", "purchase.net"]

R_SQL = """e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events),
r AS (SELECT 's' || user_id AS scan, user_id, event_id AS pos, ts, k, event_type,
CASE event_type WHEN 'view' THEN 's' || user_id || '.test' WHEN 'click' THEN 'a.click.net' WHEN 'purchase' THEN 'b.purchase.net' WHEN 'error' THEN 'err.org' ELSE 'x.signup.co.uk' END AS host,
CASE event_type WHEN 'view' THEN 's' || user_id || '.test' WHEN 'click' THEN 'click.net' WHEN 'purchase' THEN 'purchase.net' WHEN 'error' THEN 'err.org' ELSE 'signup.co.uk' END AS etld1 FROM e),
p AS (SELECT scan, CASE WHEN user_id % 2 = 0 THEN scan || '.test' ELSE arg_min(etld1, pos) END AS first_party, user_id FROM r GROUP BY scan, user_id)"""
H_SQL = f"""{R_SQL},
h AS (SELECT scan, pos, 'c' || k AS name, 'v' || k AS value, '/' AS path, CASE WHEN k % 5 <> 0 THEN k / 2.0 END AS days, CASE WHEN k % 3 = 0 THEN 'click.net' ELSE host END AS dom, CASE WHEN k % 3 = 0 THEN 'click.net' ELSE etld1 END AS dom1, etld1 FROM r WHERE k % 2 = 0
UNION ALL SELECT scan, pos, 'extra', '1', NULL, (1924992000 - epoch(ts)) / 86400.0, host, etld1, etld1 FROM r WHERE k % 2 = 0 AND k % 7 = 0)"""


def requests(spark, d) -> DataFrame:
    """Requests with response headers: every second one sets a cookie, every fourteenth two in one folded header."""
    e = events(spark, d)
    scan, k, kind = F.concat(F.lit("s"), F.col("user_id")), F.col("k"), F.col("event_type")
    host = F.when(kind == "view", F.concat(scan, F.lit(".test"))).when(kind == "click", "a.click.net").when(kind == "purchase", "b.purchase.net").when(kind == "error", "err.org").otherwise("x.signup.co.uk")
    age = F.when(k % 5 == 0, "; HttpOnly").otherwise(F.concat(F.lit("; max-age=1; Max-Age="), (k * 43200).cast("string")))
    line = F.concat(F.lit("c"), k, F.lit("=v"), k, F.lit(" ; Path=/"), age, F.when(k % 3 == 0, "; Domain=.Click.net").otherwise(""))
    folded = F.concat(line, F.when(k % 7 == 0, "\n\nextra=1; Expires=Mon, 01 Jan 2031 00:00:00 GMT").otherwise(""))
    header = lambda name, value: F.struct(F.lit(name).alias("name"), value.alias("value"))
    headers = F.when(k % 2 == 0, F.array(header("Server", F.lit("x")), header("Set-Cookie", folded))).otherwise(F.array(header("Server", F.lit("x"))))
    started = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    flat = e.select(scan.alias("scan"), "user_id", F.col("event_id").alias("pos"), F.concat(F.lit("https://"), host, F.lit("/p/"), F.col("event_id")).alias("url"), started.alias("started"), headers.alias("headers"))
    return flat.withColumn("host", U.url_host(F.col("url"))).withColumn("etld1", U.etld1(F.col("host")))


def telemetry(spark, d) -> DataFrame:
    """What collectors tell of the scans with an even number: address, browser's cookies, alarms, elements."""
    e, k = events(spark, d).where("user_id % 2 = 0"), F.col("k")
    scan, captured = F.concat(F.lit("s"), F.col("user_id")), "2024-06-01T00:00:00Z"
    at = F.unix_timestamp(F.to_timestamp(F.lit(captured)))
    cookie = F.struct(F.concat(F.lit("b"), k).alias("name"), F.lit(".purchase.net").alias("domain"), (at + k * 86400).cast("double").alias("expires"), F.lit(True).alias("third_party"))
    own = e.groupBy(scan.alias("scan")).agg(
        F.sort_array(F.collect_list(F.when((F.col("event_type") == "purchase") & (k >= 90), cookie))).alias("cookies"),
        F.sort_array(F.collect_set(F.when((F.col("event_type") == "error") & (k >= 98), F.concat(F.lit("canvas "), k)))).alias("alarms"), F.count_if(k > 95).alias("consent"), F.count_if(k > 90).cast("int").alias("elements"), F.count("*").cast("int").alias("n"),
    )
    url = F.concat(F.lit("https://"), F.col("scan"), F.lit(".test/"))
    meta = F.struct(F.concat("scan", F.lit(".test")).alias("etld1"), url.alias("final_url"), url.alias("url"), F.lit(captured).alias("captured_at"))
    observed = F.struct(F.struct("alarms").alias("fingerprinting_traps"), F.struct(F.col("cookies").alias("all_cookies")).alias("cookies"), F.array_repeat(F.lit("request"), F.col("n")).alias("all_requests"))
    seen = F.struct(F.struct(F.col("consent").alias("consent_related_count"), F.col("elements").alias("total")).alias("interactable_elements"))
    return own.select("scan", meta.alias("meta"), observed.alias("observed_behavior"), seen.alias("visual_evidence"))


def evidence_rows(spark, d) -> DataFrame:
    reqs, seen = requests(spark, d), telemetry(spark, d)
    tracking = spark.createDataFrame([(x,) for x in TRACKERS], "domain string")
    party = evidence.first_party(reqs, seen)
    totals = reqs.groupBy("scan").agg(F.count("*").alias("total_requests"))
    header = evidence.header_cookie_events(reqs, party, tracking, odd_dates=False)
    declared = reqs.where("user_id % 3 = 0").select("scan", F.lit("www.click.net").alias("domain")).distinct()
    return evidence.assemble(reqs, party, header, evidence.browser_cookie_events(seen, party, tracking), tracking, seen, totals, declared=declared)


@query(f"WITH {H_SQL} SELECT scan, pos, name, value, path, round(days, 6)::DOUBLE AS days, dom AS cookie_domain FROM h")
def q_set_cookies(spark, d):
    lines = requests(spark, d).select("scan", "pos", "host", "started", F.explode(C.header_cookies(F.col("headers"))).alias("line")).withColumn("c", C.parse_set_cookie(F.col("line")))
    attribute = lambda name: F.try_element_at("c.attributes", F.lit(name))
    days = C.header_lifetime_days(F.col("c.attributes"), F.to_timestamp("started"))
    domain = F.coalesce(F.ltrim(F.lower(attribute("domain")), F.lit(".")), F.col("host"))
    return lines.select("scan", "pos", "c.name", "c.value", attribute("path").alias("path"), F.round(days, 6).alias("days"), domain.alias("cookie_domain"))


EVIDENCE_SQL = f"""{H_SQL}, t AS (SELECT r.* FROM r JOIN p USING (scan) WHERE r.etld1 <> p.first_party), x AS (SELECT h.*, dom1 <> first_party AS third, dom1 IN ('click.net', 'purchase.net') OR h.etld1 IN ('click.net', 'purchase.net') AS tracks FROM h JOIN p USING (scan)),
hc AS (SELECT scan, count(*) AS n, count(*) FILTER (WHERE third AND tracks AND coalesce(days, 0) > 29.95) AS profiling, count(*) FILTER (WHERE third AND NOT (tracks AND coalesce(days, 0) > 29.95)) AS others FROM x GROUP BY 1),
bc AS (SELECT scan, count(*) AS n FROM r WHERE user_id % 2 = 0 AND event_type = 'purchase' AND k >= 90 GROUP BY 1),
tc AS (SELECT scan, count(*) FILTER (WHERE etld1 IN ('click.net', 'purchase.net')) AS n, string_agg(DISTINCT etld1, ' ' ORDER BY etld1) AS hosts, count(DISTINCT etld1) AS contacted, list(DISTINCT etld1) AS held FROM t GROUP BY 1),
rc AS (SELECT scan, user_id, count(*) AS n, arg_min('https://' || host || '/p/' || pos, pos) AS first_url, count(DISTINCT k) FILTER (WHERE event_type = 'error' AND k >= 98) AS alarms, count(*) FILTER (WHERE k > 95) AS consent FROM r GROUP BY 1, 2)"""


@query(f"""WITH {EVIDENCE_SQL} SELECT scan, p.first_party, CASE WHEN rc.user_id % 2 = 0 THEN 'https://' || scan || '.test/' ELSE first_url END AS scanned_url, rc.n AS total_requests, coalesce(contacted, 0)::BIGINT AS contacted, coalesce(tc.n, 0)::BIGINT AS tracker_requests, least(coalesce(tc.n, 0), 50)::BIGINT AS listed,
coalesce(hc.n, 0)::BIGINT AS set_cookies, (coalesce(profiling, 0) + coalesce(bc.n, 0))::BIGINT AS profiling, coalesce(others, 0)::BIGINT AS others, CASE WHEN rc.user_id % 2 = 0 THEN alarms ELSE 0 END::BIGINT AS alarms, CASE WHEN rc.user_id % 2 = 0 THEN consent > 0 END AS consent_ui, coalesce(hosts, '') AS hosts,
CASE WHEN rc.user_id % 3 = 0 THEN len(list_filter(coalesce(held, []), lambda v: v <> 'click.net')) END::BIGINT AS undeclared FROM rc JOIN p USING (scan) LEFT JOIN tc USING (scan) LEFT JOIN hc USING (scan) LEFT JOIN bc USING (scan)""")
def q_evidence_row(spark, d):
    """The assembled row of each scan."""
    size = lambda c: F.size(c).cast("bigint")
    return evidence_rows(spark, d).select(
        "scan", "first_party", "scanned_url", F.col("summary.total_requests").alias("total_requests"), F.col("summary.third_party_domains_contacted").cast("bigint").alias("contacted"), F.col("summary.tracker_requests").alias("tracker_requests"),
        size("tracker_requests").alias("listed"), F.col("summary.set_cookie_events").alias("set_cookies"), F.col("summary.pre_consent_profiling_cookies").alias("profiling"), size("other_third_party_cookies").alias("others"),
        F.col("summary.fingerprinting_alarms").cast("bigint").alias("alarms"), F.col("consent_ui_detected").alias("consent_ui"), F.array_join("third_party_domains", " ").alias("hosts"),
        F.when(F.col("declared_vs_actual").isNotNull(), size("declared_vs_actual.undeclared_domains")).alias("undeclared"),
    )


@query(f"""WITH {EVIDENCE_SQL}, d AS (SELECT unnest(['hosts', 'text']) AS dimension), l AS (SELECT rc.scan, first_party, consent, rc.user_id, list_sort(coalesce(held, [])) AS l FROM rc JOIN p USING (scan) LEFT JOIN tc USING (scan))
SELECT scan, dimension, dimension = 'hosts' AND len(l) > 0 AS has_events, CASE WHEN dimension = 'text' THEN '(This dimension is about policy text; behavioural evidence does not apply.)' WHEN len(l) = 0 THEN 'No event of the relevant kinds was observed, so no behavioural violation may be asserted for this dimension: judge the policy text alone.'
ELSE 'third_party_domains (' || len(l) || '):' || chr(10) || array_to_string(list_transform(l[:2], lambda v: '  - ' || v), chr(10)) || CASE WHEN len(l) > 2 THEN chr(10) || '  ... and ' || (len(l) - 2) || ' more' ELSE '' END END AS body FROM l, d""")
def q_evidence_text(spark, d):
    """What a prompt shows of a scan's evidence for a dimension, below its fixed head."""
    dims = spark.createDataFrame([("hosts", ["third_party_domains"]), ("text", [])], "dimension string, evidence_keys array<string>")
    rows = rendering.by_dimension(evidence_rows(spark, d), dims, most=2)
    body = F.regexp_extract("evidence_text", r"(?s)\n\n(.*)\z", 1)
    last = F.regexp_extract("evidence_text", r"\n(\(This dimension.*)\z", 1)
    return rows.select("scan", "dimension", "has_events", F.when(F.col("dimension") == "text", last).otherwise(body).alias("body"))


@query("SELECT 's' || user_id AS scan, count(*)::INTEGER AS requests, (count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90))::INTEGER AS ui_elements, count(*) >= 60 AND count(*) FILTER (WHERE CAST(json_extract_string(props, '$.k') AS BIGINT) > 90) > 0 AS healthy FROM events WHERE user_id % 2 = 0 GROUP BY user_id")
def q_capture_health(spark, d):
    return audit.capture_health(telemetry(spark, d), least=60)


@query(r"""WITH l AS (SELECT l_orderkey, list(DISTINCT (l_partkey % 7)::VARCHAR) AS got FROM lineitem GROUP BY 1)
SELECT CASE WHEN o_orderkey % 9 = 0 THEN 'N/A' WHEN got IS NULL THEN 'N/A' WHEN o_orderkey % 5 = 0 THEN 'UNSUPPORTED' WHEN list_contains(got, (o_orderkey % 7)::VARCHAR) THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS status, count(*) AS n FROM orders LEFT JOIN l ON l_orderkey = o_orderkey GROUP BY 1""")
def q_citation_status(spark, d):
    """Orders cite an article with a paragraph, some of another law; their lines are what was retrieved."""
    article = F.struct(F.lit("GDPR").alias("regulation"), (F.col("l_partkey") % 7).cast("string").alias("article"))
    retrieved = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.collect_set(article).alias("retrieved"))
    o = table(spark, d, "orders").join(retrieved, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    key = F.col("o_orderkey")
    cited = F.when(key % 9 != 0, F.concat(F.lit("Article "), (key % 7).cast("string"), F.lit("(1)")))
    status = grounding.citation_status(cited, F.when(key % 5 == 0, "PECR").when(key % 2 == 0, "gdpr"), F.col("retrieved"))
    return o.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


NUMBERED = r"\b(\d{3})\b"


@query(rf"""WITH t AS (SELECT doc_id, regexp_replace(regexp_replace(text, '(?i)the', 'PECR', 'g'), '{NUMBERED}', 'gdpr Art. \1b', 'g') AS t FROM documents), p AS (SELECT '(?i)(EPRIVACY-IE|GDPR|PECR|DPDP|CCPA|ePrivacy)\s+(?:Art|Article|Reg|Regulation|§)\.?\s*(\d+[A-Za-z]?)' AS p),
x AS (SELECT doc_id, upper(unnest(regexp_extract_all(t, p, 1))) AS regulation, unnest(regexp_extract_all(t, p, 2)) AS article FROM t, p) SELECT regulation, article, count(*) AS n, count(DISTINCT doc_id) AS docs FROM x GROUP BY 1, 2""")
def q_law_citations(spark, d):
    """References in texts whose three-digit numbers are written as articles."""
    text = F.regexp_replace(F.regexp_replace("text", "(?i)the", "PECR"), NUMBERED, "gdpr Art. $1b")
    refs = table(spark, d, "documents").select("doc_id", F.explode(X.law_references(text)).alias("r"))
    return refs.groupBy("r.regulation", "r.article").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


LOOKUP_SQL = """f AS (SELECT DISTINCT 'f' || c_custkey % 500 || '.test_privacy_policy.md' AS file FROM customer WHERE c_custkey % 3 = 0 UNION SELECT DISTINCT 'host' || c_nationkey || '.example_cookie_policy.md' FROM customer WHERE c_nationkey % 2 = 0 UNION SELECT DISTINCT lower(c_mktsegment) || c_custkey % 90 || '_terms_policy.md' FROM customer),
s AS (SELECT DISTINCT CASE WHEN c_custkey % 4 = 0 THEN 'www.' || lower(c_mktsegment) || c_custkey % 9 || '.ie' ELSE 'f' || c_custkey % 500 || '.test' END AS domain FROM customer), m AS (SELECT DISTINCT 'f' || c_custkey % 500 || '.test' AS domain, 'host' || c_nationkey || '.example' AS host FROM customer WHERE c_custkey % 5 = 0),
k AS (SELECT unnest(['privacy', 'cookie']) AS kind)"""


@query(f"""WITH {LOOKUP_SQL}, t AS (SELECT domain, file, 1 AS tier FROM s, k JOIN f ON file = domain || '_' || kind || '_policy.md' UNION SELECT domain, file, 2 FROM s JOIN m USING (domain), k JOIN f ON file = host || '_' || kind || '_policy.md'
UNION SELECT domain, file, 3 FROM s JOIN f ON contains(file, split_part(replace(domain, 'www.', ''), '.', 1))) SELECT domain, file, tier FROM (SELECT *, min(tier) OVER (PARTITION BY domain) AS least FROM t) WHERE tier = least""")
def q_policy_lookup(spark, d):
    """The policy files of sites, which customers stand for, by name, by mapped host, or by a name that holds the site's."""
    c = table(spark, d, "customer")
    key, nation, segment = F.col("c_custkey"), F.col("c_nationkey"), F.lower("c_mktsegment")
    own = F.concat(F.lit("f"), key % 500, F.lit(".test"))
    names = [c.where(key % 3 == 0).select(F.concat(own, F.lit("_privacy_policy.md"))), c.where(nation % 2 == 0).select(F.concat(F.lit("host"), nation, F.lit(".example_cookie_policy.md"))), c.select(F.concat(segment, key % 90, F.lit("_terms_policy.md")))]
    files = names[0].union(names[1]).union(names[2]).toDF("file")
    sites = c.select(F.when(key % 4 == 0, F.concat(F.lit("www."), segment, key % 9, F.lit(".ie"))).otherwise(own).alias("domain"))
    mapping = c.where(key % 5 == 0).select(own.alias("domain"), F.concat(F.lit("host"), nation, F.lit(".example")).alias("host")).distinct()
    return policies.find_policies(sites, files, mapping)


@query(f"""WITH {S_SQL}, c AS (SELECT c_custkey AS site, c_mktsegment AS sector, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 40 END AS requests, c_custkey % 3 AS ui, c_custkey % 4 AS files FROM customer), n AS (SELECT site, count(*) AS rows_, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'NOT_ADDRESSED') AS n_not FROM v GROUP BY 1)
SELECT c.site::VARCHAR AS domain, sector, CASE WHEN requests IS NULL THEN 'collector_failed' WHEN requests < 10 OR ui = 0 THEN 'blocked' WHEN rows_ IS NULL THEN 'scorer_failed' ELSE 'ok' END AS status, files::BIGINT AS policies_found, overall_score, CASE WHEN rows_ IS NOT NULL THEN {BAND_SQL} END AS overall_verdict, rows_ AS n_dimensions, n_fail, n_not AS n_not_addressed,
CASE WHEN requests < 10 OR (requests IS NOT NULL AND ui = 0) THEN requests || ' requests, ' || ui || ' UI elements' ELSE '' END AS notes FROM c LEFT JOIN n USING (site) LEFT JOIN o USING (site)""")
def q_batch_record(spark, d):
    """A batch's record of each site: customers are sites, their orders verdicts."""
    key = F.col("c_custkey")
    c = table(spark, d, "customer").select(key.cast("string").alias("domain"), F.col("c_mktsegment").alias("sector"), F.lit("IE").alias("jurisdiction"), (key % 40).cast("int").alias("requests"), (key % 3).cast("int").alias("ui_elements"), (key % 4).alias("n_files"), (key % 11 != 0).alias("seen"))
    health = c.where("seen").select("domain", "requests", "ui_elements", ((F.col("requests") >= audit.LEAST_REQUESTS) & (F.col("ui_elements") > 0)).alias("healthy"))
    scored = verdict_rows(spark, d).select(F.col("site").cast("string").alias("domain"), F.col("id").alias("dimension"), "verdict", "score", "severity")
    checked = scored.groupBy("domain").agg(F.lit(1.0).alias("grounding_rate"), F.lit(0).alias("dimensions_with_issues"))
    got = audit.batch(c.select("domain", "sector", "jurisdiction"), health, scored, checked, c.select("domain", "n_files"))
    return got.select("domain", "sector", "status", "policies_found", "overall_score", "overall_verdict", "n_dimensions", "n_fail", "n_not_addressed", "notes")


@query("""WITH c AS (SELECT conv_id, turn, role, coalesce(text, '') AS t FROM conversations) SELECT role, CASE WHEN length(t) % 3 = 0 THEN 'FAIL' WHEN length(t) % 3 = 1 THEN 'PASS' ELSE 'PARTIAL' END AS verdict, count(*) AS n, sum(length(t) % 101)::BIGINT AS total, count(DISTINCT t) AS prompts FROM c GROUP BY 1, 2""")
def q_answers(spark, d):
    """Turns as prompts, each different one asked once; the answers are stored by digest and parsed."""

    def answer(prompts: list[str]) -> list[str]:
        return ["```json\n" + json.dumps({"verdict": ["FAIL", "PASS", "PARTIAL"][len(p) % 3], "score": len(p) % 101}) + "\n```" for p in prompts]

    turns = table(spark, d, "conversations").select("role", F.coalesce("text", F.lit("")).alias("prompt"))
    scored = audit.score_with(turns, answer, store=f"{fresh_folder(spark, 'answers')}/answers")
    return scored.groupBy("role", "verdict").agg(F.count("*").alias("n"), F.sum("score").alias("total"), F.count_distinct("prompt").alias("prompts"))


@query(f"WITH {V_SQL}, h AS (SELECT CASE WHEN id % 2 = 0 THEN 0 ELSE site END AS site, id, score FROM v) SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY score ASC NULLS LAST, id)::INTEGER AS place FROM h")
def q_hot_order(spark, d):
    """Places within sites of which one has half of all rows, without a task for each site."""
    rows = verdict_rows(spark, d).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("site")).alias("site"), "id", "score")
    return ordering.places(rows, "site", [F.asc_nulls_last("score"), F.asc("id")]).select("site", "id", "place")
