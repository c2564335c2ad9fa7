"""Queries over orders, which stand for verdicts, and labels, which stand for two annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.operators import agreement as A
from attestry.operators import rollups as R
from attestry.operators import verdicts as V
from attestry.operators import verification
from attestry.operators.evidence import DECLARED
from attestry.plans.registry import query, table

V_SQL = """v AS (SELECT o_orderkey AS id, o_custkey AS site, CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' ELSE 'low' END AS severity,
CASE WHEN o_orderkey % 10 = 0 THEN 'NOT_ADDRESSED' WHEN o_orderstatus = 'F' THEN 'FAIL' WHEN o_orderstatus = 'O' THEN 'PARTIAL' ELSE 'PASS' END AS verdict,
CASE WHEN o_orderkey % 10 <> 0 THEN CAST((o_orderkey * 37) % 101 AS INTEGER) END AS score FROM orders)"""
W_SQL = "CASE severity WHEN 'critical' THEN 3.0 WHEN 'high' THEN 2.0 WHEN 'medium' THEN 1.0 ELSE 0.5 END::DOUBLE"
S_SQL = f"""{V_SQL}, o AS (SELECT site, CAST(round_even(sum(({W_SQL}) * score) FILTER (WHERE score IS NOT NULL) / sum({W_SQL}) FILTER (WHERE score IS NOT NULL), 0) AS INTEGER) AS overall_score, count(score) AS n_scored, count(*) AS n_rows FROM v GROUP BY 1)"""
BAND_SQL = "CASE WHEN overall_score IS NULL THEN 'INSUFFICIENT_DATA' WHEN overall_score >= 75 THEN 'LIKELY_COMPLIANT' WHEN overall_score >= 50 THEN 'PARTIAL' ELSE 'POTENTIAL_NON_COMPLIANCE' END"


def verdict_rows(spark, d) -> DataFrame:
    o = table(spark, d, "orders")
    key, p, s = F.col("o_orderkey"), F.col("o_orderpriority"), F.col("o_orderstatus")
    severity = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").otherwise("low")
    verdict = F.when(key % 10 == 0, "NOT_ADDRESSED").when(s == "F", "FAIL").when(s == "O", "PARTIAL").otherwise("PASS")
    return o.select(key.alias("id"), F.col("o_custkey").alias("site"), severity.alias("severity"), verdict.alias("verdict"), F.when(key % 10 != 0, (key * 37) % 101).cast("int").alias("score"), p.alias("priority"), s.alias("order_status"))


@query(f"WITH {S_SQL} SELECT *, {BAND_SQL} AS overall_verdict FROM o")
def q_weighted_score(spark, d):
    return V.overall(verdict_rows(spark, d))


@query(f"WITH {V_SQL} SELECT CASE WHEN score IS NULL THEN 'grey' WHEN score >= 75 THEN 'green' WHEN score >= 50 THEN 'amber' ELSE 'red' END AS colour, count(*) AS n FROM v GROUP BY 1")
def q_score_band(spark, d):
    return verdict_rows(spark, d).groupBy(X.score_band(F.col("score")).alias("colour")).agg(F.count("*").alias("n"))


@query(f"WITH {V_SQL} SELECT site, count(*) AS dimensions, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'PARTIAL') AS n_partial, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'NOT_ADDRESSED') AS n_not_addressed FROM v GROUP BY 1")
def q_verdict_counts(spark, d):
    kinds = ["FAIL", "PARTIAL", "PASS", "NOT_ADDRESSED"]
    return verdict_rows(spark, d).groupBy("site").agg(F.count("*").alias("dimensions"), *(F.count_if(F.col("verdict") == k).alias(f"n_{k.lower()}") for k in kinds))


@query(f"""WITH {V_SQL}, x AS (SELECT site, id % 3 AS dim, max(score) AS score, max(verdict) AS verdict FROM v GROUP BY 1, 2), dims AS (SELECT unnest([0, 1, 2]) AS dim, unnest(['cookies', 'consent', 'rights']) AS dimension),
s AS (SELECT c_custkey AS site, c_nationkey % 4 <> 0 AS has_policy, c_custkey % 3 <> 0 AS has_events FROM customer)
SELECT site, dimension, 'NOT_ADDRESSED' AS verdict, NULL::INTEGER AS score, true AS guarded FROM s, dims WHERE NOT has_policy AND NOT has_events
UNION ALL SELECT s.site, dimension, x.verdict, x.score, false FROM s JOIN dims ON has_policy OR has_events JOIN x ON x.site = s.site AND x.dim = dims.dim""")
def q_guard_union(spark, d):
    dims = spark.createDataFrame([(0, "cookies"), (1, "consent"), (2, "rights")], "dim bigint, dimension string")
    scored = verdict_rows(spark, d).groupBy("site", (F.col("id") % 3).alias("dim")).agg(F.max("score").alias("score"), F.max("verdict").alias("verdict")).join(F.broadcast(dims), "dim").select("site", "dimension", "verdict", "score")
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"), (F.col("c_nationkey") % 4 != 0).alias("has_policy"), (F.col("c_custkey") % 3 != 0).alias("has_events"))
    return V.guarded(sites, dims.select("dimension"), scored)


@query(f"""WITH {V_SQL}, f AS (SELECT id, verdict, score, CASE WHEN id % 7 = 0 THEN '7' END AS article, CASE WHEN id % 5 < 2 THEN 'x' END AS claim, CASE WHEN id % 4 < 2 THEN 'y' END AS behaviour, CASE id % 6 WHEN 0 THEN 'neglect' WHEN 1 THEN 'contrary' WHEN 2 THEN 'inadequate' END AS disc, id % 11 <> 0 AS has_policy FROM v),
i AS (SELECT id, unnest([CASE WHEN verdict = 'NOT_ADDRESSED' AND (article IS NOT NULL OR score IS NOT NULL) THEN 'not addressed, yet cited or scored' END, CASE WHEN disc = 'neglect' AND behaviour IS NULL THEN 'neglect without behaviour' END, CASE WHEN disc = 'neglect' AND behaviour IS NOT NULL AND NOT has_policy THEN 'neglect without a policy' END,
CASE WHEN disc IN ('contrary', 'inadequate') AND (claim IS NULL OR behaviour IS NULL) THEN 'contradiction without both sides' END, CASE WHEN (verdict = 'PASS' AND score < 60) OR (verdict = 'PARTIAL' AND (score < 25 OR score > 85)) OR (verdict = 'FAIL' AND score > 60) THEN 'score outside its band' END,
CASE WHEN verdict IN ('FAIL', 'PARTIAL') AND claim IS NULL AND behaviour IS NULL THEN 'finding without any support' END]) AS issue FROM f) SELECT issue, count(*) AS n, min(id) AS first_id FROM i WHERE issue IS NOT NULL GROUP BY 1""")
def q_consistency(spark, d):
    i = F.col("id")
    issues = V.consistency_issues(
        F.col("verdict"), F.col("score"), F.when(i % 7 == 0, "7"), F.when(i % 5 < 2, "x"), F.when(i % 4 < 2, "y"), F.when(i % 6 == 0, "neglect").when(i % 6 == 1, "contrary").when(i % 6 == 2, "inadequate"), i % 11 != 0
    )
    rows = verdict_rows(spark, d).select("id", F.explode(issues).alias("issue"))
    return rows.groupBy("issue").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


@query("""WITH r AS (SELECT DISTINCT l_orderkey, l_partkey % 7 AS article FROM lineitem) SELECT count(*) AS cited, count(*) FILTER (WHERE EXISTS (SELECT 1 FROM r WHERE r.l_orderkey = o_orderkey AND r.article = o_orderkey % 7)) AS grounded FROM orders""")
def q_citation_exists(spark, d):
    retrieved = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("_k"), (F.col("l_partkey") % 7).alias("_a")).distinct()
    o = table(spark, d, "orders")
    joined = o.join(retrieved, (F.col("o_orderkey") == F.col("_k")) & (F.col("o_orderkey") % 7 == F.col("_a")), "left")
    return joined.agg(F.count("*").alias("cited"), F.count("_k").alias("grounded"))


STATUS_SQL = f"{S_SQL}, t AS (SELECT *, CASE WHEN site % 13 = 0 THEN 'blocked' WHEN site % 17 = 0 THEN 'collector_failed' WHEN site % 19 = 0 THEN 'reused' ELSE 'ok' END AS status FROM o)"


def sites(spark, d) -> DataFrame:
    s = F.col("site")
    status = F.when(s % 13 == 0, "blocked").when(s % 17 == 0, "collector_failed").when(s % 19 == 0, "reused").otherwise("ok")
    return V.overall(verdict_rows(spark, d)).withColumn("status", status).withColumnRenamed("overall_score", "score")


@query(f"WITH {STATUS_SQL} SELECT count(*) AS attempted, count(*) FILTER (WHERE status IN ('ok', 'reused') AND overall_score IS NOT NULL) AS scored, count(*) FILTER (WHERE status = 'blocked') AS blocked, count(*) FILTER (WHERE status = 'collector_failed') AS failed, round(count(*) FILTER (WHERE status = 'blocked') / count(*)::DOUBLE, 6) AS blocked_rate FROM t")
def q_status_counts(spark, d):
    return R.status_totals(sites(spark, d))


@query(f"""WITH {S_SQL}, g AS (SELECT site, count(*) FILTER (WHERE verdict = 'FAIL') AS fails, count(*) AS dimensions FROM v GROUP BY 1)
SELECT r_name AS sector, count(*) AS n, round(avg(overall_score), 4) AS mean_score, sum(fails)::BIGINT AS fails, sum(dimensions)::BIGINT AS dimensions, round(100 * sum(fails)::DOUBLE / sum(dimensions), 4) AS fail_pct FROM o JOIN g USING (site) JOIN customer ON c_custkey = site JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey GROUP BY 1""")
def q_sector_rollup(spark, d):
    more = F.count_if(F.col("verdict") == "FAIL").alias("fails"), F.count("*").alias("dimensions")
    sector = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", F.col("r_name").alias("sector"))
    c = table(spark, d, "customer").join(sector, F.col("c_nationkey") == F.col("n_nationkey")).select(F.col("c_custkey").alias("site"), "sector")
    return R.by_sector(V.overall(verdict_rows(spark, d), extra=more).withColumnRenamed("overall_score", "score").join(c, "site"))


C_SQL = f"{S_SQL}, c AS (SELECT site % 3 AS policies, overall_score AS score, CASE WHEN site % 3 = 1 OR site % 5 <> 0 THEN (site % 9) / 8.0::DOUBLE END AS grounding FROM o)"


def confound_rows(spark, d):
    s = F.col("site")
    return V.overall(verdict_rows(spark, d)).select((s % 3).alias("policies"), F.col("overall_score").alias("score"), F.when((s % 3 == 1) | (s % 5 != 0), (s % 9) / F.lit(8.0)).alias("grounding"))


@query(f"""WITH {C_SQL} SELECT policies, count(*) AS n, round(avg(score), 4) AS mean_score, round(coalesce(avg(grounding), 0), 4) AS mean_grounding, (SELECT round(avg(score) FILTER (WHERE policies > 0) - avg(score) FILTER (WHERE policies = 0), 4) FROM c) AS difference FROM c GROUP BY 1""")
def q_confound(spark, d):
    rows = confound_rows(spark, d)
    return R.confound(rows).crossJoin(F.broadcast(R.two_arms(rows).select("difference")))  # one row


@query(f"WITH {V_SQL} SELECT severity, count(*) FILTER (WHERE verdict = 'PASS') AS n_pass, count(*) FILTER (WHERE verdict = 'FAIL') AS n_fail, count(*) FILTER (WHERE verdict = 'PARTIAL') AS n_partial, count(*) FILTER (WHERE verdict = 'NOT_ADDRESSED') AS n_not_addressed, count(DISTINCT verdict) AS n_distinct FROM v GROUP BY 1")
def q_pivot_verdicts(spark, d):
    return R.verdict_pivot(verdict_rows(spark, d), "severity", "verdict", ["PASS", "FAIL", "PARTIAL", "NOT_ADDRESSED"])


@query(f"WITH {S_SQL} SELECT min(overall_score) AS least, max(overall_score) AS most, round(avg(overall_score), 4) AS mean, count(DISTINCT overall_score) AS n_distinct, count(overall_score) AS n FROM o")
def q_score_stats(spark, d):
    s = F.col("overall_score")
    return V.overall(verdict_rows(spark, d)).agg(F.min(s).alias("least"), F.max(s).alias("most"), F.round(F.avg(s), 4).alias("mean"), F.count_distinct(s).alias("n_distinct"), F.count(s).alias("n"))


@query(f"WITH {S_SQL} SELECT overall_score, count(*) AS n FROM o WHERE overall_score IS NOT NULL GROUP BY 1")
def q_histogram(spark, d):
    return V.overall(verdict_rows(spark, d)).where("overall_score IS NOT NULL").groupBy("overall_score").agg(F.count("*").alias("n"))


K_SQL = f"{V_SQL}, k AS (SELECT unnest(['C1', 'C2', 'C3']) AS check_id, unnest([id % 3, id % 4, id % 7]) AS c FROM v), n AS (SELECT check_id, CASE WHEN c = 0 THEN 'NA' WHEN c = 1 AND check_id <> 'C3' THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS status FROM k)"


@query(f"WITH {K_SQL} SELECT check_id, count(*) FILTER (WHERE status = 'SUPPORTED') AS n_supported, count(*) FILTER (WHERE status = 'UNSUPPORTED') AS n_unsupported, count(*) FILTER (WHERE status = 'NA') AS n_na, count(DISTINCT status) AS n_distinct FROM n GROUP BY 1")
def q_check_tally(spark, d):
    i = F.col("id")
    checks = F.explode(F.create_map(F.lit("C1"), i % 3, F.lit("C2"), i % 4, F.lit("C3"), i % 7)).alias("check_id", "c")
    rows = verdict_rows(spark, d).select(checks)
    status = F.when(F.col("c") == 0, "NA").when((F.col("c") == 1) & (F.col("check_id") != "C3"), "UNSUPPORTED").otherwise("SUPPORTED")
    return R.verdict_pivot(rows.withColumn("status", status), "check_id", "status", ["SUPPORTED", "UNSUPPORTED", "NA"])


@query(f"""WITH {V_SQL}, g AS (SELECT id % 5 = 0 AS legacy, CASE id % 4 WHEN 0 THEN 0 WHEN 1 THEN 0 WHEN 2 THEN 1 ELSE 2 END AS n FROM v) SELECT round_even(count(*) FILTER (WHERE n = 0 AND NOT legacy) / count(*) FILTER (WHERE NOT legacy)::DOUBLE, 3) AS grounding_rate, round_even(count(*) FILTER (WHERE n = 0) / count(*)::DOUBLE, 3) AS grounding_rate_all, sum(n)::BIGINT AS issues FROM g""")
def q_grounding(spark, d):
    from attestry.operators.grounding import grounding

    i = F.col("id") % 4
    issues = F.array_repeat(F.lit("x"), F.when(i < 2, 0).when(i == 2, 1).otherwise(2))
    return grounding(verdict_rows(spark, d).select((F.col("id") % 5 == 0).alias("legacy"), issues.alias("issues")))


ISSUES = ["C4: domain 'a.b' not in telemetry", "C2: requirement_text not found (paraphrased, not a quotation)", "C3: policy text unavailable to the verifier", "C5: score outside its band", "C3: no matching text found in source"]
I_SQL = f"{V_SQL}, i AS (SELECT id AS pos, [{', '.join(chr(39) + x.replace(chr(39), chr(39) * 2) + chr(39) for x in ISSUES)}][(id % 5 + 1)::INTEGER] || ' #' || site AS issue FROM v WHERE verdict = 'FAIL')"


def issue_rows(spark, d) -> DataFrame:
    text = F.concat(F.element_at(F.array(*map(F.lit, ISSUES)), (F.col("id") % 5 + 1).cast("int")), F.lit(" #"), F.col("site").cast("string"))
    return verdict_rows(spark, d).where("verdict = 'FAIL'").select(F.col("id").alias("pos"), text.alias("issue"))


@query(f"WITH {I_SQL} SELECT string_split(issue, ':')[1] AS bucket, count(*) AS n, substr(arg_min(issue, pos), 1, 110) AS example FROM i GROUP BY 1")
def q_issue_buckets(spark, d):
    return R.issue_buckets(issue_rows(spark, d))


@query(f"""WITH {I_SQL}, c AS (SELECT CASE WHEN regexp_matches(issue, 'not in telemetry|not corroborated') THEN 'fabricated' WHEN contains(issue, 'paraphrased') THEN 'paraphrase' WHEN contains(issue, 'no matching text found') THEN 'unlocatable' WHEN regexp_matches(issue, 'no policy text was retrieved|unavailable|could not be checked') THEN 'missing_input' ELSE 'inconsistency' END AS cause FROM i WHERE contains(issue, 'C')),
k AS (SELECT unnest(['fabricated', 'unlocatable', 'paraphrase', 'missing_input', 'inconsistency']) AS cause) SELECT cause, (SELECT count(*) FROM c WHERE c.cause = k.cause) AS n FROM k""")
def q_flag_attribution(spark, d):
    return R.flag_causes(issue_rows(spark, d))


@query(f"WITH {V_SQL} SELECT site, id, row_number() OVER (PARTITION BY site ORDER BY score ASC NULLS LAST, id)::INTEGER AS place FROM v")
def q_report_order(spark, d):
    w = Window.partitionBy("site").orderBy(F.asc_nulls_last("score"), "id")
    return verdict_rows(spark, d).select("site", "id", F.row_number().over(w).alias("place"))


@query("""WITH t AS (SELECT c_custkey, 1 AS tier, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey WHERE c_custkey % 3 = 0 UNION ALL SELECT c_custkey, 2, n_name FROM customer JOIN nation ON n_nationkey = (c_custkey % 40) UNION ALL SELECT c_custkey, 3, n_name FROM customer JOIN nation ON ends_with(n_name, right(c_name, 1)) AND length(n_name) = 8)
SELECT c_custkey, min(tier) AS tier, arg_min(n_name, (tier, n_name)) AS n_name FROM t GROUP BY 1""")
def q_tiered_lookup(spark, d):
    c, n = table(spark, d, "customer"), table(spark, d, "nation").select("n_nationkey", "n_name")
    tier = lambda df, k: df.select("c_custkey", F.lit(k).alias("tier"), "n_name")
    exact = tier(c.where("c_custkey % 3 = 0").join(n, F.col("c_nationkey") == F.col("n_nationkey")), 1)
    mapped = tier(c.join(n, F.col("c_custkey") % 40 == F.col("n_nationkey")), 2)
    # The last letter of the name, as a key, stands for the stem that file names hold.
    stem = tier(c.withColumn("stem", F.right("c_name", F.lit(1))).join(n.where(F.length("n_name") == 8).withColumn("stem", F.right("n_name", F.lit(1))), "stem"), 3)
    return exact.unionByName(mapped).unionByName(stem).groupBy("c_custkey").agg(F.min("tier").alias("tier"), F.min_by("n_name", F.struct("tier", "n_name")).alias("n_name"))


# Agreement of two raters.

P_SQL = "p AS (SELECT l.doc_id, lang, quality AS human, toxic AS system FROM labels l LEFT JOIN documents d USING (doc_id))"


def pairs(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "lang")
    return table(spark, d, "labels").join(docs, "doc_id", "left").select("lang", F.col("quality").alias("human"), F.col("toxic").alias("system"))


@query("""WITH a AS (SELECT doc_id, quality, doc_id % 7 <> 0 AS known FROM labels), r AS (SELECT DISTINCT doc_id FROM documents WHERE doc_id % 7 <> 0)
SELECT quality AS human, count(*) AS annotated, count(r.doc_id) AS matched, count(*) - count(r.doc_id) AS missing FROM a LEFT JOIN r USING (doc_id) GROUP BY 1""")
def q_matched_rows(spark, d):
    human = table(spark, d, "labels").select("doc_id", F.col("quality").alias("human"))
    system = table(spark, d, "documents").where("doc_id % 7 <> 0").select("doc_id", F.col("lang").alias("verdict")).dropDuplicates(["doc_id"])
    m = A.matched(human, system, ["doc_id"])
    return m.groupBy("human").agg(F.count("*").alias("annotated"), F.count_if("matched").alias("matched"), F.count_if(~F.col("matched")).alias("missing"))


@query(f"WITH {P_SQL} SELECT lang, count(*) AS n, count(*) FILTER (WHERE human = system) AS matches, round(count(*) FILTER (WHERE human = system) / count(*)::DOUBLE, 6) AS ratio FROM p GROUP BY 1")
def q_agreement(spark, d):
    return A.agreement(pairs(spark, d), ["lang"])


def _kappa_sql(by: str, group: str) -> str:
    return f"""SELECT {by} AS lang, count(*) AS n, round(CASE WHEN abs(1 - pe) < 1e-12 THEN 1.0 ELSE (po - pe) / (1 - pe) END, 6) AS kappa FROM (SELECT *, avg((human = system)::INT) OVER ({group}) AS po, avg((human = 1)::INT) OVER ({group}) * avg((system = 1)::INT) OVER ({group}) + avg((human = 0)::INT) OVER ({group}) * avg((system = 0)::INT) OVER ({group}) AS pe FROM p) GROUP BY 1, po, pe"""


@query(f"WITH {P_SQL} {_kappa_sql(chr(39) + 'all' + chr(39), '')} UNION ALL {_kappa_sql('lang', 'PARTITION BY lang')}")
def q_kappa(spark, d):
    p = pairs(spark, d)
    return A.kappa(p, [0, 1]).select(F.lit("all").alias("lang"), "n", "kappa").unionByName(A.kappa(p, [0, 1], ["lang"]))


PRF_SQL = """c AS (SELECT v.label, count(*) FILTER (WHERE human = v.label AND system = v.label) AS tp, count(*) FILTER (WHERE human = v.label) AS hs, count(*) FILTER (WHERE system = v.label) AS ss FROM p, (SELECT unnest([0, 1]) AS label) v GROUP BY 1),
r AS (SELECT *, CASE WHEN ss > 0 THEN tp / ss::DOUBLE ELSE 0 END AS pr, CASE WHEN hs > 0 THEN tp / hs::DOUBLE ELSE 0 END AS re FROM c), f AS (SELECT *, CASE WHEN pr + re > 0 THEN 2 * pr * re / (pr + re) ELSE 0 END AS f FROM r)"""


@query(f"WITH {P_SQL}, {PRF_SQL} SELECT label, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1, hs AS human_support, ss AS system_support, (SELECT round(avg(round(f, 6)), 6) FROM f WHERE hs > 0 OR ss > 0) AS macro_f1 FROM f")
def q_prf(spark, d):
    scores = A.prf(pairs(spark, d), [0, 1])
    return scores.crossJoin(F.broadcast(A.macro_f1(scores)))  # one row


@query(f"WITH {P_SQL}, {PRF_SQL} SELECT tp, ss - tp AS fp, hs - tp AS fn, round(pr, 6) AS precision, round(re, 6) AS recall, round(f, 6) AS f1 FROM f WHERE label = 1")
def q_binary_prf(spark, d):
    return A.binary(pairs(spark, d), [1])


@query(f"WITH {P_SQL} SELECT human, count(*) FILTER (WHERE system = 0) AS system_0, count(*) FILTER (WHERE system = 1) AS system_1 FROM p GROUP BY 1")
def q_confusion(spark, d):
    return A.confusion(pairs(spark, d), [0, 1])


# Verification: orders stand for a report's dimensions, the events of users with a site's number for its evidence.

VERIFY_SQL = f"""WITH {V_SQL}, r AS (SELECT id, site % 100 AS k, verdict, score, id % 7 = 0 AS cited, site % 100 % 3 <> 0 AS pol, id % 5 < 2 AS claim, id % 4 <> 2 AS behaviour, CASE id % 6 WHEN 0 THEN 'neglect' WHEN 1 THEN 'contrary' END AS disc FROM v),
e AS (SELECT user_id % 100 AS k, bool_or(event_type = 'click') AS c, bool_or(event_type = 'purchase') AND bool_or(event_type = 'view') AS pv FROM events WHERE value > 45 GROUP BY 1),
x AS (SELECT r.*, coalesce(c, false) AS c, coalesce(pv, false) AS pv FROM r LEFT JOIN e USING (k)),
s AS (SELECT *, CASE WHEN NOT cited THEN 'N/A' WHEN id % 2 = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS c1, CASE WHEN id % 3 = 0 THEN 'SUPPORTED' ELSE 'N/A' END AS c2,
CASE WHEN NOT pol OR NOT claim THEN 'N/A' WHEN id % 5 = 0 THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS c3, CASE WHEN NOT behaviour THEN 'N/A' WHEN (id % 4 = 0 AND c) OR (id % 4 = 3 AND pv) THEN 'SUPPORTED' ELSE 'UNSUPPORTED' END AS c4,
CASE WHEN (verdict = 'NOT_ADDRESSED' AND (cited OR score IS NOT NULL)) OR (disc = 'neglect' AND NOT (behaviour AND pol)) OR (disc = 'contrary' AND NOT (claim AND behaviour)) OR (verdict = 'PASS' AND score < 60) OR (verdict = 'PARTIAL' AND (score < 25 OR score > 85))
OR (verdict = 'FAIL' AND score > 60) OR (verdict IN ('FAIL', 'PARTIAL') AND NOT claim AND NOT behaviour) THEN 'UNSUPPORTED' ELSE 'SUPPORTED' END AS c5 FROM x),
g AS (SELECT *, NOT (c1 = 'UNSUPPORTED' OR c3 = 'UNSUPPORTED' OR (claim AND NOT pol) OR c4 = 'UNSUPPORTED' OR c5 = 'UNSUPPORTED') AS fine FROM s)
SELECT 's' || k || '.test' AS site, count(*) AS dimensions, count(*) FILTER (WHERE fine) AS grounded, round_even(count(*) FILTER (WHERE fine) / count(*)::DOUBLE, 3) AS grounding_rate,
{", ".join(f"count(*) FILTER (WHERE c{i} = 'UNSUPPORTED') AS c{i}_unsupported, count(*) FILTER (WHERE c{i} = 'N/A') AS c{i}_na" for i in range(1, 6))} FROM g GROUP BY k"""


@query(VERIFY_SQL)
def q_verify(spark, d):
    site = lambda k: F.concat(F.lit("s"), (k % 100).cast("string"), F.lit(".test"))
    i = F.col("id")
    breach = F.struct(F.when(i % 7 == 0, "GDPR").alias("regulation"), F.when(i % 7 == 0, "Article 7(1)").alias("article"), F.when(i % 3 == 0, "consent shall be freely given").alias("requirement_text"))
    retrieved = F.array(F.struct(F.lit("GDPR").alias("regulation"), F.when(i % 2 == 0, "7").otherwise("9").alias("article")))
    rows = verdict_rows(spark, d).select(
        site(F.col("site")).alias("site"), i.cast("string").alias("dimension"), "verdict", "score", F.lit(0.5).alias("confidence"), F.when(i % 5 == 0, "We share data with partners").when(i % 5 == 1, "zz qq xx zz qq xx zz qq xx").alias("policy_claim"),
        F.when(i % 4 == 0, "click.net was contacted").when(i % 4 == 1, "bogus.org was contacted").when(i % 4 == 3, "purchase.net and view.net").alias("behavioral_evidence"),
        F.when(i % 6 == 0, "neglect").when(i % 6 == 1, "contrary").alias("discrepancy_type"), breach.alias("breach"), retrieved.alias("retrieved_articles"), F.lit("Consent shall be freely given and may be withdrawn.").alias("rule_text"),
    )
    cookies, none = "array<struct<name:string,cookie_domain:string>>", F.array()
    seen = table(spark, d, "events").where("value > 45").groupBy(site(F.col("user_id")).alias("scan")).agg(F.sort_array(F.collect_set(F.concat("event_type", F.lit(".net")))).alias("third_party_domains"))
    found = seen.select(
        "scan", F.col("scan").alias("first_party"), F.concat(F.lit("https://"), F.col("scan")).alias("scanned_url"), "third_party_domains", none.cast("array<struct<etld1:string>>").alias("tracker_requests"),
        *(none.cast(cookies).alias(c) for c in ("pre_consent_profiling_cookies", "js_set_profiling_cookies", "other_third_party_cookies")), none.cast("array<string>").alias("fingerprinting_alarms"), F.lit(None).cast(DECLARED).alias("declared_vs_actual"),
    )
    policies = rows.select("site").distinct().where(F.regexp_extract("site", r"\d+", 0).cast("int") % 3 != 0).withColumn("policy_text", F.lit("In this notice: we share data with partners for advertising."))
    got = verification.summary(verification.verify(rows, verification.universe(found), policies))
    counts = [F.col(f"{c}.{k}").alias(f"c{n}_{k}") for n, c in enumerate(verification.CHECKS, 1) for k in ("unsupported", "na")]
    return got.select("site", F.col("dimensions_checked").alias("dimensions"), F.col("dimensions_fully_grounded").alias("grounded"), "grounding_rate", *counts)
