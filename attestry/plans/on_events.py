"""Queries over events, which stand for requests and cookies of sites (users)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import cookies as C
from attestry.functions import text as X
from attestry.operators import evidence, policies, trackers, verdicts
from attestry.plans.registry import query, table

E_SQL = "e AS (SELECT *, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events)"
LIST_A = [("purchase", "Advertising"), ("click", "Analytics"), ("view", "Content")]
LIST_B = ["purchase", "error"]


def events(spark, d) -> DataFrame:
    return table(spark, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))


def lists(spark):
    a = spark.createDataFrame(LIST_A, "domain string, category string")
    b = spark.createDataFrame([(x,) for x in LIST_B], "domain string")
    own = spark.createDataFrame([("signup",)], "domain string")
    return a, b, own


@query(f"WITH {E_SQL} SELECT event_id, CASE WHEN epoch(ts) + (k - 20) * 86400 > 0 AND k > 20 THEN round((k - 20)::DOUBLE, 4) END AS days FROM e")
def q_lifetime(spark, d):
    ts = F.col("ts").cast("timestamp")
    expires = F.when(F.col("k") > 20, F.unix_micros(ts) / 1e6 + (F.col("k") - 20) * 86400)
    return events(spark, d).select("event_id", F.round(C.epoch_lifetime_days(expires, ts), 4).alias("days"))


@query(f"WITH {E_SQL} SELECT event_type, count(*) AS n, count(*) FILTER (WHERE user_id % 3 <> 0 AND event_type IN ('click', 'purchase') AND k > 29.95) AS profiling_header, count(*) FILTER (WHERE user_id % 3 <> 0 AND event_type IN ('click', 'purchase') AND k >= 30) AS profiling_browser FROM e GROUP BY 1")
def q_profiling_rule(spark, d):
    third, tracker, days = F.col("user_id") % 3 != 0, F.col("event_type").isin("click", "purchase"), F.col("k").cast("double")
    header, browser = (C.is_profiling(third, tracker, f(days)) for f in (C.long_lived_header, C.long_lived_browser))
    return events(spark, d).groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(header).alias("profiling_header"), F.count_if(browser).alias("profiling_browser"))


@query(f"""WITH {E_SQL}, c AS (SELECT CASE event_type WHEN 'purchase' THEN 'Advertising' WHEN 'click' THEN 'Analytics' WHEN 'view' THEN 'Content' WHEN 'error' THEN 'tracker' WHEN 'signup' THEN 'tracker' END AS category, user_id FROM e) SELECT user_id, category, count(*) AS n FROM c GROUP BY 1, 2""")
def q_tracker_category(spark, d):
    a, b, own = lists(spark)
    return trackers.with_category(events(spark, d), a, b, own, "event_type").groupBy("user_id", "category").agg(F.count("*").alias("n"))


@query("""WITH m AS (SELECT * FROM (VALUES ('intersection', 'purchase'), ('single_a', 'purchase'), ('single_a', 'click'), ('single_b', 'purchase'), ('single_b', 'error'), ('builtin', 'signup')) t(mode, domain)) SELECT mode, count(*) AS n, count(DISTINCT user_id) AS users FROM events JOIN m ON event_type = domain GROUP BY 1""")
def q_tracker_modes(spark, d):
    a, b, own = lists(spark)
    t = trackers.tracker_domains(a, b, own)
    return events(spark, d).join(t, F.col("event_type") == F.col("domain")).groupBy("mode").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


@query("SELECT user_id, count(*) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'purchase' AND value > 30) AND user_id IN (SELECT user_id FROM events WHERE event_type = 'error' AND value > 30) GROUP BY 1")
def q_intersection_semi(spark, d):
    e = events(spark, d)
    of = lambda kind: e.where((F.col("event_type") == kind) & (F.col("value") > 30)).select("user_id")
    return e.join(of("purchase"), "user_id", "left_semi").join(of("error"), "user_id", "left_semi").groupBy("user_id").agg(F.count("*").alias("n"))


@query(f"WITH {E_SQL}, a AS (SELECT DISTINCT user_id, event_type FROM e WHERE k >= 80), b AS (SELECT DISTINCT user_id, event_type FROM e WHERE k < 40) SELECT * FROM a WHERE NOT EXISTS (SELECT 1 FROM b WHERE a.user_id IS NOT DISTINCT FROM b.user_id AND a.event_type IS NOT DISTINCT FROM b.event_type)")
def q_js_only_anti(spark, d):
    e, keys = events(spark, d), ["user_id", "event_type"]
    return trackers.only_in_first(e.where("k >= 80").select(*keys).distinct(), e.where("k < 40"), keys)


@query(f"WITH {E_SQL}, o AS (SELECT DISTINCT user_id AS site, event_type AS item FROM e), x AS (SELECT DISTINCT user_id, event_type FROM e WHERE k > 50 AND value < 20) SELECT site, item, 'neglect' AS discrepancy FROM o WHERE NOT EXISTS (SELECT 1 FROM x WHERE x.user_id = site AND x.event_type = item)")
def q_undeclared(spark, d):
    e = events(spark, d).select(F.col("user_id").alias("site"), F.col("event_type").alias("item"), "k", "value")
    return trackers.undeclared(e.select("site", "item"), e.where("k > 50 AND value < 20").select("site", "item"))


@query("""WITH c AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click' AND value > 40), p AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'purchase' AND value > 40)
SELECT 'union' AS op, user_id FROM (SELECT * FROM c UNION SELECT * FROM p) UNION ALL SELECT 'intersect', user_id FROM (SELECT * FROM c INTERSECT SELECT * FROM p) UNION ALL SELECT 'except', user_id FROM (SELECT * FROM c EXCEPT SELECT * FROM p) UNION ALL SELECT 'bag', user_id FROM (SELECT * FROM c UNION ALL SELECT * FROM p)""")
def q_set_ops(spark, d):
    of = lambda kind: events(spark, d).where((F.col("event_type") == kind) & (F.col("value") > 40)).select("user_id").distinct()
    c, p = of("click"), of("purchase")
    tag = lambda df, op: df.select(F.lit(op).alias("op"), "user_id")
    return tag(c.union(p).distinct(), "union").union(tag(c.intersect(p), "intersect")).union(tag(c.subtract(p), "except")).union(tag(c.union(p), "bag"))


@query(f"WITH {E_SQL} SELECT user_id, count(*) AS requests, count(DISTINCT event_type) AS kinds, count(*) FILTER (WHERE event_type IN ('click', 'purchase')) AS tracker_requests, count(*) FILTER (WHERE k > 0) AS set_events, count(*) FILTER (WHERE k >= 30 AND event_type = 'purchase') + count(*) FILTER (WHERE k >= 30 AND event_type = 'click') AS profiling, count(*) FILTER (WHERE event_type = 'error') AS alarms FROM e GROUP BY 1")
def q_evidence_summary(spark, d):
    t, k = F.col("event_type"), F.col("k")
    return events(spark, d).groupBy("user_id").agg(
        F.count("*").alias("requests"), F.count_distinct("event_type").alias("kinds"), F.count_if(t.isin("click", "purchase")).alias("tracker_requests"), F.count_if(k > 0).alias("set_events"),
        (F.count_if((k >= 30) & (t == "purchase")) + F.count_if((k >= 30) & (t == "click"))).alias("profiling"), F.count_if(t == "error").alias("alarms"),
    )


@query("SELECT user_id, count(*) AS total, count(*) FILTER (WHERE event_type <> 'view') AS third_party, count(*) FILTER (WHERE event_type <> 'view' AND event_id % 3 = 0) AS third_party_posts, coalesce(string_agg(DISTINCT event_type, ' ' ORDER BY event_type) FILTER (WHERE event_type <> 'view'), '') AS hosts FROM events GROUP BY 1")
def q_network_summary(spark, d):
    requests = events(spark, d).select("user_id", F.col("event_type").alias("domain"), F.when(F.col("event_id") % 3 == 0, "post").otherwise("GET").alias("method"), (F.col("event_type") != "view").alias("third_party"))
    return evidence.network_summary(requests, ["user_id"]).select("user_id", "total", "third_party", "third_party_posts", F.array_join("third_party_domains", " ").alias("hosts"))


@query("SELECT user_id, count(*) < 60 OR count(*) FILTER (WHERE event_type = 'error' AND value > 10) = 0 AS blocked FROM events GROUP BY 1")
def q_health_gate(spark, d):
    return events(spark, d).groupBy("user_id").agg(((F.count("*") < 60) | (F.count_if((F.col("event_type") == "error") & (F.col("value") > 10)) == 0)).alias("blocked"))


@query("SELECT user_id, arg_max(event_id, (ts, event_id)) AS event_id, max(ts) AS ts FROM events GROUP BY 1")
def q_latest_per_key(spark, d):
    return events(spark, d).groupBy("user_id").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.max("ts").alias("ts"))


@query("WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rk FROM events) SELECT user_id, string_agg(event_id::VARCHAR, ' ' ORDER BY event_id) FILTER (WHERE rk <= 5) AS first_events, greatest(count(*) - 5, 0) AS overflow FROM r GROUP BY 1")
def q_capped_list(spark, d):
    # The first five are found before they are gathered, so a user's list is short however many events there are.
    e, w = events(spark, d), Window.partitionBy("user_id").orderBy("event_id")
    first = e.select("user_id", "event_id", F.row_number().over(w).alias("rk")).where("rk <= 5").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list("event_id")), lambda x: x.cast("string")), " ").alias("first_events"))
    return e.groupBy("user_id").agg(F.greatest(F.count("*") - 5, F.lit(0)).alias("overflow")).join(first, "user_id").select("user_id", "first_events", "overflow")


RAW = """CASE event_id % 10 WHEN 0 THEN '```json\n{"verdict": "PASS", "score": ' || (k * 3) || ', "confidence": 7.5}\n```' WHEN 1 THEN 'Sure: {"verdict": "FAIL", "score": "' || k || '", "confidence": 0.25, "discrepancy_type": "neglect"} done'
 WHEN 2 THEN '{"verdict": "MAYBE", "score": ' || k || '.9, "confidence": "0.75"}' WHEN 3 THEN 'no object here ' || k WHEN 4 THEN '{"verdict": "NOT_ADDRESSED", "score": ' || k || ', "confidence": -2}' WHEN 5 THEN '{"verdict": "PARTIAL", "score": "' || k || '.5", "discrepancy_type": "odd"}'
 WHEN 6 THEN '{"verdict": "pass", "score": true, "confidence": false}' WHEN 7 THEN '{"verdict": "FAIL", "score": null, "confidence": "high", "discrepancy_type": "contrary"}' WHEN 8 THEN '{"verdict": "PASS", "score": -' || k || '.5}' ELSE '{"verdict": "PASS", "score": ' || k END"""


@query(f"""WITH {E_SQL} SELECT event_id, CASE event_id % 10 WHEN 0 THEN 'PASS' WHEN 1 THEN 'FAIL' WHEN 3 THEN 'ERROR' WHEN 4 THEN 'NOT_ADDRESSED' WHEN 7 THEN 'FAIL' WHEN 8 THEN 'PASS' WHEN 9 THEN 'ERROR' ELSE 'PARTIAL' END AS verdict,
CAST(CASE event_id % 10 WHEN 0 THEN least(100, k * 3) WHEN 1 THEN k WHEN 2 THEN k WHEN 4 THEN k WHEN 6 THEN 1 WHEN 8 THEN 0 END AS INTEGER) AS score,
CASE event_id % 10 WHEN 0 THEN 1.0 WHEN 1 THEN 0.25 WHEN 2 THEN 0.75 WHEN 3 THEN 0.0 WHEN 4 THEN 0.0 WHEN 6 THEN 0.0 WHEN 9 THEN 0.0 ELSE 0.5 END::DOUBLE AS confidence, CASE event_id % 10 WHEN 1 THEN 'neglect' WHEN 7 THEN 'contrary' END AS discrepancy_type FROM e""")
def q_parse_response(spark, d):
    raw = events(spark, d).select("event_id", F.expr(RAW).alias("raw"))
    return raw.select("event_id", verdicts.parse_response(F.col("raw")).alias("p")).select("event_id", "p.*")


@query("""WITH s AS (SELECT DISTINCT user_id, event_type || ':' || CAST(json_extract_string(props, '$.k') AS BIGINT) AS item FROM events WHERE value > 35), r AS (SELECT user_id, item, row_number() OVER (PARTITION BY user_id ORDER BY item) AS rk, count(*) OVER (PARTITION BY user_id) AS n FROM s)
SELECT user_id, string_agg('- ' || item, chr(10) ORDER BY rk) FILTER (WHERE rk <= 12) || CASE WHEN max(n) > 12 THEN chr(10) || '… and ' || (max(n) - 12) || ' more' ELSE '' END AS context FROM r GROUP BY 1""")
def q_render_context(spark, d):
    items = events(spark, d).where("value > 35").select("user_id", F.concat("event_type", F.lit(":"), F.col("k").cast("string")).alias("item")).distinct()
    ranked = items.withColumn("rk", F.row_number().over(Window.partitionBy("user_id").orderBy("item")))
    grouped = ranked.groupBy("user_id").agg(F.count("*").alias("n"), F.sort_array(F.collect_list(F.when(F.col("rk") <= 12, F.col("item")))).alias("shown"))
    more = F.when(F.col("n") > 12, F.array(F.format_string("… and %d more", F.col("n") - 12))).otherwise(F.array().cast("array<string>"))
    return grouped.select("user_id", F.array_join(F.concat(X.capped_list(F.col("shown"), 12), more), "\n").alias("context"))


@query("""WITH m AS (SELECT user_id, max(event_id) FILTER (WHERE event_type = CASE WHEN user_id % 2 = 0 THEN 'purchase' ELSE 'none' END) AS hit, min(event_id) AS first FROM events GROUP BY 1)
SELECT m.user_id, e.event_type AS url, CASE WHEN hit IS NULL THEN 'fallback_first_document' ELSE 'final_url' END AS found_by FROM m JOIN events e ON e.event_id = coalesce(hit, first)""")
def q_main_response(spark, d):
    e = events(spark, d).select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("url"))
    wanted = e.select("user_id").distinct().withColumn("final_url", F.when(F.col("user_id") % 2 == 0, "purchase").otherwise("none"))
    return policies.main_response(e, wanted, "user_id")


ANSWERS = """CASE event_id % 5 WHEN 0 THEN '```json\n{"privacy_policy": {"url": "https://u/' || k || '", "reason": "r"}}\n```' WHEN 1 THEN '{"privacy_policy": {"reason": "no url"}, "cookie_policy": {"url": "c' || k || '"}}'
 WHEN 2 THEN 'no json' WHEN 3 THEN '{"privacy_policy": "text", "cookie_policy": {"looks_correct": true}}' ELSE '{"privacy_policy": {"looks_correct": false, "reason": "x"}, "cookie_policy": {"url": ""}}' END"""


@query(f"""WITH {E_SQL} SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'https://u/' || k END AS privacy_url, CASE event_id % 5 WHEN 1 THEN 'c' || k END AS cookie_url, CASE event_id % 5 WHEN 4 THEN false END AS privacy_ok, CASE event_id % 5 WHEN 3 THEN true END AS cookie_ok FROM e""")
def q_answer_filters(spark, d):
    raw = events(spark, d).select("event_id", F.expr(ANSWERS).alias("raw"))
    got = raw.select("event_id", policies.picked_urls(F.col("raw")).alias("u"), policies.checked_documents(F.col("raw")).alias("c"))
    at = lambda m, k, f: F.try_element_at(m, F.lit(k))[f]
    return got.select("event_id", at("u", "privacy_policy", "url").alias("privacy_url"), at("u", "cookie_policy", "url").alias("cookie_url"), at("c", "privacy_policy", "looks_correct").alias("privacy_ok"), at("c", "cookie_policy", "looks_correct").alias("cookie_ok"))
