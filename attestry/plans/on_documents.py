"""Queries over documents, benchmark passages and conversations: legal and policy text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.functions import vocab
from attestry.functions.fuzzy import excerpt
from attestry.operators import grounding, policies, retrieval, vector_index
from attestry.plans.registry import query, table

#: A stand-in for headings: a line that begins with a word in Th.
HEADING = r"(Th[a-z]*) "
WORDS = [("cookies", ["idiot", "$$$"]), ("consent", ["thea", "quel"]), ("rights", ["ándo", "keit"])]


def docs(spark, d) -> DataFrame:
    return table(spark, d, "documents")


CHUNK_SQL = """WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
m AS (SELECT *, regexp_matches(line, '^(?i:th[a-z]*) ') AS head, sum(CASE WHEN regexp_matches(line, '^(?i:th[a-z]*) ') THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS g FROM l),
c AS (SELECT doc_id, g, trim(string_agg(line, chr(10) ORDER BY pos), chr(32) || chr(9) || chr(13) || chr(10)) AS t FROM m WHERE g > 0 GROUP BY 1, 2),
k AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY g) - 1 AS idx, regexp_extract(t, '^(?i:(th[a-z]*)) ', 1) AS number, t FROM c WHERE length(t) >= 120),
f AS (SELECT doc_id, 0 AS idx, '1' AS number, trim(text, chr(32) || chr(9) || chr(13) || chr(10)) AS t FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM m WHERE head))
SELECT doc_id, idx::INTEGER AS idx, number, length(t) AS n_chars FROM (SELECT * FROM k UNION ALL SELECT * FROM f WHERE t <> '')"""


@query(CHUNK_SQL)
def q_chunk_documents(spark, d):
    units = docs(spark, d).select("doc_id", F.posexplode(X.legal_units(F.col("text"), HEADING)).alias("idx", "u"))
    return units.select("doc_id", "idx", "u.number", F.length("u.text").alias("n_chars"))


@query("""SELECT CASE WHEN regexp_matches(lower(text), 'idiot|\\$\\$\\$') THEN 'cookies' WHEN regexp_matches(lower(text), 'thea|quel') THEN 'consent' WHEN regexp_matches(lower(text), 'ándo|keit') THEN 'rights' ELSE 'general' END AS requirement_type, count(*) AS n FROM documents GROUP BY 1""")
def q_requirement_type(spark, d):
    return docs(spark, d).groupBy(X.requirement_type(F.col("text"), WORDS).alias("requirement_type")).agg(F.count("*").alias("n"))


@query(r"""SELECT doc_id, md5(lower(trim(regexp_replace(translate(text, '‘’“”–—' || chr(160), '''''""-- '), '\s+', ' ', 'g')))) AS digest FROM documents""")
def q_norm_text(spark, d):
    return docs(spark, d).select("doc_id", F.md5(X.norm(F.col("text"))).alias("digest"))


@query("""WITH f AS (SELECT doc_id AS site, 0 AS pos, 'privacy.md' AS name, text FROM documents UNION ALL SELECT conv_id, 1 + turn, role || '.md', text FROM conversations),
b AS (SELECT site, pos, name, '--- ' || name || ' ---' || chr(10) || CASE WHEN length(text) > 60000 THEN substr(text, 1, 60000) || chr(10) || '[... truncated ...]' ELSE coalesce(text, '') END AS block FROM f),
t AS (SELECT site, string_agg(block, chr(10) || chr(10) ORDER BY pos, name, block) AS t, count(*) AS n FROM b GROUP BY 1) SELECT c_custkey AS site, coalesce(n, 0)::BIGINT AS n_files, CASE WHEN t IS NULL THEN 'none' ELSE md5(t) END AS digest FROM customer LEFT JOIN t ON site = c_custkey""")
def q_policy_context(spark, d):
    """Customers stand for sites, the document and the turns with a site's number for its policy files."""
    own = docs(spark, d).select(F.col("doc_id").alias("site"), F.lit(0).cast("bigint").alias("pos"), F.lit("privacy.md").alias("name"), "text")
    more = table(spark, d, "conversations").select(F.col("conv_id").alias("site"), (F.col("turn") + 1).cast("bigint").alias("pos"), F.concat("role", F.lit(".md")).alias("name"), "text")
    sites = table(spark, d, "customer").select(F.col("c_custkey").alias("site"))
    got = policies.policy_text(own.unionByName(more), sites)
    return got.select("site", "n_files", F.when(F.col("policy_text") == policies.NO_POLICY, "none").otherwise(F.md5("policy_text")).alias("digest"))


@query("SELECT b.item_id, count(*) AS n_docs, min(doc_id) AS first_doc FROM documents d JOIN benchmark b ON contains(d.text, b.text) GROUP BY 1")
def q_quote_verbatim(spark, d):
    quotes = table(spark, d, "benchmark").select(F.col("item_id").alias("quote_id"), F.col("text").alias("quote"))
    held = grounding.containing(quotes, docs(spark, d).select(F.col("doc_id").alias("text_id"), "text"))
    return held.groupBy(F.col("quote_id").alias("item_id")).agg(F.count("*").alias("n_docs"), F.min("text_id").alias("first_doc"))


@query()
def q_quote_fuzzy(spark, d):
    """Each document's first words with one letter changed, as a quotation of it."""
    head = F.substring("text", 1, 80)
    quote = F.when(F.col("doc_id") % 3 == 0, head).otherwise(F.concat(F.substring(head, 1, 30), F.lit("#"), F.substring(head, 32, 49)))
    rows = docs(spark, d).select("doc_id", quote.alias("quote"), F.col("text").alias("source"))
    return grounding.quote_checks(rows).select("doc_id", "status", "ratio", "note")


@query(r"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all(text, '(?i)([a-z0-9-]+\.[a-z]{2,})', 1)) AS m FROM documents) SELECT lower(m) AS domain, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""")
def q_extract_domains(spark, d):
    found = F.transform(F.regexp_extract_all("text", F.lit(r"(?i)([a-z0-9-]+\.[a-z]{2,})"), 1), F.lower)
    return docs(spark, d).select("doc_id", F.explode(found).alias("domain")).groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


@query(r"""WITH t AS (SELECT doc_id, CASE WHEN length(text) > 4000 THEN substr(text, 1, 2000) || ' ' || right(text, 2000) ELSE text END AS s FROM documents)
SELECT doc_id, coalesce(nullif(regexp_extract(s, '(\d{3})[) -]+\d{3}', 1), ''), nullif(regexp_extract(s, '(?i)(th[a-z]{6,7}) ', 1), ''), nullif(regexp_extract(s, '(\d{4})', 1), '')) AS found FROM t""")
def q_effective_date(spark, d):
    forms = [r"(\d{3})[) -]+\d{3}", r"(?i)(th[a-z]{6,7}) ", r"(\d{4})"]
    return docs(spark, d).select("doc_id", X.effective_date(F.col("text"), forms).alias("found"))


@query(r"""SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) AS words, CASE WHEN length(trim(text)) < 100 THEN 'skip' WHEN len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) < 300 THEN 'thin' WHEN len(regexp_extract_all(text, '[^ \t\n\r\f\v]+')) < 500 THEN 'hub_check' ELSE 'full' END AS gate FROM documents""")
def q_word_gate(spark, d):
    return docs(spark, d).select("doc_id", X.word_count(F.col("text")).alias("words"), X.word_gate(F.col("text")).alias("gate"))


@query(r"""WITH t AS (SELECT doc_id, source, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda x: length(trim(x)) > 120)) AS long_sentences, len(regexp_extract_all(text, 'http')) AS links FROM documents),
x AS (SELECT *, long_sentences / greatest(1, links)::DOUBLE AS density FROM t), r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY density DESC, doc_id) AS rk FROM x) SELECT source, doc_id, round(density, 4) AS density FROM r WHERE rk = 1""")
def q_legal_density(spark, d):
    density = X.legal_density(F.col("text"), F.regexp_count("text", F.lit("http")))
    rows = docs(spark, d).select("source", "doc_id", density.alias("density"))
    best = rows.groupBy("source").agg(F.max_by(F.struct("doc_id", "density"), F.struct("density", -F.col("doc_id"))).alias("b"))
    return best.select("source", "b.doc_id", F.round("b.density", 4).alias("density"))


_BARE = r"regexp_replace(lower({0}), '[^\p{{L}}\p{{N}}]+', '', 'g')"


@query(f"""WITH b AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x, chr(32) || chr(9) || chr(13) || chr(10))), lambda x: x <> '') AS l FROM documents),
k AS (SELECT doc_id, len(l) AS blocks, list_reduce(list_transform(l, lambda x: [x]), lambda acc, x: CASE WHEN length(x[1]) >= 30 AND len(list_filter(acc[-3:], lambda y: contains({_BARE.format('y')}, {_BARE.format('x[1]')}))) > 0 THEN acc ELSE list_concat(acc, x) END, CAST([] AS VARCHAR[])) AS kept FROM b)
SELECT doc_id, blocks, len(kept) AS kept, md5(array_to_string(kept, chr(10) || chr(10))) AS digest FROM k""")
def q_block_dedupe(spark, d):
    blocks = F.split(F.coalesce("text", F.lit("")), "\n")
    kept = X.dedupe_blocks(blocks)
    some = F.filter(blocks, lambda x: F.btrim(x, F.lit(" \t\r\n")) != "")
    rows = docs(spark, d).select("doc_id", F.size(some).cast("bigint").alias("blocks"), kept.alias("k"))
    return rows.select("doc_id", "blocks", F.size("k").cast("bigint").alias("kept"), F.md5(F.array_join("k", "\n\n")).alias("digest"))


def _count(part: str) -> str:
    return f"((length(x) - length(replace(x, {part}, ''))) // length({part}))"


EXCERPT_SQL = f"""WITH w AS (SELECT unnest([0, 1]) AS wi, unnest(['thea ', 'que ']) AS w), s AS (SELECT doc_id, text, wi, w, string_split(lower(text), w) AS parts FROM documents, w WHERE text <> ''),
k AS (SELECT *, unnest(range(1, len(parts))) AS k FROM s), a AS (SELECT doc_id, text, wi, k, greatest(0, list_sum(list_transform(parts[1:k], lambda y: length(y))) + (k - 1) * length(w) - 200)::BIGINT AS start FROM k),
x AS (SELECT doc_id, wi, k, substr(text, start + 1, 900) AS x FROM a), p AS (SELECT *, 2 * {_count("'. '")} - 3 * ({_count("']('")} + {_count("'](#'")}) - {_count("chr(10) || '-'")} - {_count("chr(10) || '*'")} AS score FROM x),
b AS (SELECT doc_id, arg_max(x, (score, -wi, -k)) AS x FROM p GROUP BY 1), f AS (SELECT doc_id, CASE WHEN coalesce(d.text, '') = '' THEN 'NO POLICY RETRIEVED' ELSE trim(regexp_replace(coalesce(b.x, substr(d.text, 1, 900)), '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) END AS t FROM documents d LEFT JOIN b USING (doc_id))
SELECT doc_id, md5(t) AS digest FROM f"""


@query(EXCERPT_SQL)
def q_excerpt(spark, d):
    return docs(spark, d).select("doc_id", F.md5(excerpt(F.col("text"), ["thea ", "que "])).alias("digest"))


@query(r"""WITH l AS (SELECT conv_id, turn, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS pos FROM conversations) SELECT conv_id, turn, pos, md5(trim(line)) AS digest FROM l WHERE trim(line) <> ''""")
def q_explode_lines(spark, d):
    lines = table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    return lines.where(F.trim("line") != "").select("conv_id", "turn", "pos", F.md5(F.trim("line")).alias("digest"))


@query("WITH w AS (SELECT conv_id, unnest(string_split(lower(text), ' ')) AS w FROM conversations) SELECT conv_id, count(DISTINCT w) AS n_words, min(w) AS first_word, max(w) AS last_word FROM w GROUP BY 1")
def q_flatten_union(spark, d):
    w = table(spark, d, "conversations").select("conv_id", F.explode(F.split(F.lower("text"), " ")).alias("w"))
    return w.groupBy("conv_id").agg(F.count_distinct("w").alias("n_words"), F.min("w").alias("first_word"), F.max("w").alias("last_word"))


def _sql_list(values) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


LAWS = f"SELECT unnest({_sql_list(x[0] for x in vocab.DIMENSIONS)}) AS dimension, unnest({_sql_list(x[1] for x in vocab.DIMENSIONS)}) AS refs"
_REF = r"'(?i)(EPRIVACY-IE|GDPR|PECR|DPDP|CCPA|ePrivacy)\s+(?:Art|Article|Reg|Regulation|§)\.?\s*(\d+[A-Za-z]?)'"


@query(rf"""WITH l AS ({LAWS}), r AS (SELECT dimension, regexp_extract_all(refs, {_REF}, 1) AS a, regexp_extract_all(refs, {_REF}, 2) AS b FROM l), c AS (SELECT dimension, upper(unnest(a)) AS regulation, unnest(b) AS article FROM r),
t AS (SELECT doc_id, regexp_replace(text, '(\d)\d\d', 'GDPR Art \1 ', 'g') AS t FROM documents), x AS (SELECT doc_id, upper(unnest(regexp_extract_all(t, {_REF}, 1))) AS regulation, unnest(regexp_extract_all(t, {_REF}, 2)) AS article FROM t),
d AS (SELECT DISTINCT * FROM x) SELECT dimension, regulation, article, count(doc_id) AS docs FROM c LEFT JOIN d USING (regulation, article) GROUP BY ALL""")
def q_law_refs(spark, d):
    """What the dimensions refer to, and how many documents cite it; numbers of three digits stand for articles."""
    dims = spark.createDataFrame([(x[0], x[1]) for x in vocab.DIMENSIONS], "dimension string, refs string")
    controls = dims.select("dimension", F.explode(X.law_references(F.col("refs"))).alias("r")).select("dimension", "r.*")
    text = F.regexp_replace("text", r"(\d)\d\d", "GDPR Art $1 ")
    cited = docs(spark, d).select("doc_id", F.explode(F.array_distinct(X.law_references(text))).alias("r")).groupBy("r.regulation", "r.article").agg(F.count_distinct("doc_id").alias("docs"))
    return controls.join(cited, ["regulation", "article"], "left").select("dimension", "regulation", "article", F.coalesce("docs", F.lit(0)).alias("docs"))


@query(rf"""WITH t AS (SELECT doc_id, lower(unnest(regexp_extract_all(text, '{vocab.DOMAIN}', 1))) AS domain FROM documents) SELECT domain, count(*) AS n, count(DISTINCT doc_id) AS docs FROM t GROUP BY 1""")
def q_claimed_domains(spark, d):
    found = docs(spark, d).select("doc_id", F.explode(X.domains_in(F.col("text"))).alias("domain"))
    return found.groupBy("domain").agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("docs"))


# Retrieval. Every hundredth vector is a query against all vectors.

V_SQL = """v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT vec_id AS query_id, label AS q_label, e AS qe FROM v WHERE vec_id % 100 = 0),
s AS (SELECT query_id, q_label, vec_id, label, list_cosine_similarity(qe, e) AS sim FROM q, v)"""


def vectors(spark, d):
    v = retrieval.with_norm(table(spark, d, "embeddings")).withColumn("chunk_id", F.col("vec_id"))
    return v, v.where("vec_id % 100 = 0").withColumn("query_id", F.col("vec_id"))


TOPK_SQL = f"WITH {V_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM s WHERE label = q_label) SELECT query_id, vec_id, rk::INTEGER AS rank, round(sim, 4) AS sim FROM r WHERE rk <= 4"


@query(TOPK_SQL)
def q_vector_topk(spark, d):
    v, q = vectors(spark, d)
    return vector_index.nearest(q, v, 4, ["label"]).select("query_id", "vec_id", "rank", F.round("sim", 4).alias("sim"))


POSTFILTER_SQL = f"WITH {V_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, rk::INTEGER AS rank FROM r WHERE rk <= 5 AND label IN (1, 3, 5, 7)"


@query(POSTFILTER_SQL)
def q_topk_postfilter(spark, d):
    v, q = vectors(spark, d)
    return vector_index.nearest(q, v, 5).where(F.col("label").isin(1, 3, 5, 7)).select("query_id", "vec_id", "rank")


@query(f"""WITH {V_SQL}, f AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM s WHERE label = CASE WHEN query_id % 200 = 0 THEN q_label ELSE -1 END),
u AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS rk FROM s) SELECT query_id, vec_id, true AS filtered FROM f WHERE rk <= 3 UNION ALL SELECT query_id, vec_id, false FROM u WHERE rk <= 3 AND query_id NOT IN (SELECT query_id FROM f)""")
def q_topk_fallback(spark, d):
    v, q = vectors(spark, d)
    asked = q.withColumn("label", F.when(F.col("query_id") % 200 == 0, F.col("label")).otherwise(-1))
    filtered = vector_index.nearest(asked, v, 3, ["label"])
    every = vector_index.nearest(q, v, 3)
    return retrieval.with_fallback(filtered.select("query_id", "vec_id"), every.select("query_id", "vec_id"))


@query(f"""WITH {V_SQL}, refs AS (SELECT query_id, unnest([(q_label + 1) % 10, (q_label + 2) % 10]) AS label FROM q),
a AS (SELECT query_id, vec_id, row_number() OVER (PARTITION BY query_id, label ORDER BY vec_id) AS n FROM refs JOIN v USING (label)),
a2 AS (SELECT query_id, vec_id, 0 AS src, vec_id AS pos FROM a WHERE n <= 2), t AS (SELECT query_id, vec_id, 1 AS src, row_number() OVER (PARTITION BY query_id ORDER BY sim DESC, vec_id) AS pos FROM s),
e AS (SELECT * FROM a2 UNION ALL SELECT * FROM t WHERE pos <= 3), f AS (SELECT *, row_number() OVER (PARTITION BY query_id, vec_id ORDER BY src, pos) AS d FROM e),
g AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY src, pos) AS rank, sum(CASE WHEN src = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY query_id) AS n FROM f WHERE d = 1) SELECT query_id, vec_id, src, rank::INTEGER AS rank FROM g WHERE rank <= greatest(3, n)""")
def q_anchor_join(spark, d):
    v, q = vectors(spark, d)
    refs = q.select("query_id", F.explode(F.array(*((F.col("label") + i) % 10 for i in (1, 2)))).alias("label"))
    anchor = retrieval.anchors(refs, v.select("label", "chunk_id"), ["label"], 2).select("query_id", "chunk_id", F.col("chunk_id").alias("pos"))
    semantic = vector_index.nearest(q, v, 3).select("query_id", "chunk_id", F.col("rank").cast("bigint").alias("pos"))
    return retrieval.merged(anchor, semantic, ["chunk_id"], 3).select("query_id", F.col("chunk_id").alias("vec_id"), "src", "rank")


@query(TOPK_SQL)
def q_index_topk(spark, d):
    """q_vector_topk by an index."""
    v, q = vectors(spark, d)
    return vector_index.index_top_k(q.drop("chunk_id", "vec_id"), v, 4, ["label"]).select("query_id", "vec_id", "rank", F.round("sim", 4).alias("sim"))


@query(POSTFILTER_SQL)
def q_index_postfilter(spark, d):
    """q_topk_postfilter by an index."""
    v, q = vectors(spark, d)
    return vector_index.index_top_k(q.drop("chunk_id", "vec_id"), v, 5).where(F.col("label").isin(1, 3, 5, 7)).select("query_id", "vec_id", "rank")
