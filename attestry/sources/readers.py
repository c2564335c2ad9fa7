"""Readers with declared schemas: nothing is inferred, a missing field and a null one read alike."""

from __future__ import annotations

from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.urls import any_of, is_trusted, url_host

LOC = r"(?is)<loc>\s*(.*?)\s*</loc>"
HEADER = "struct<name:string,value:string>"
HAR = f"log struct<version:string,entries:array<struct<startedDateTime:string,request:struct<url:string,method:string,headers:array<{HEADER}>>,response:struct<status:int,headers:array<{HEADER}>>>>>"
COOKIE = "struct<name:string,domain:string,path:string,secure:boolean,httpOnly:boolean,sameSite:string,expires:double,third_party:boolean>"
TELEMETRY = (
    "meta struct<url:string,final_url:string,domain:string,etld1:string,captured_at:string>, "
    "infrastructure_security struct<https_enforced:boolean,security_headers:map<string,string>,missing_headers:array<string>>, "
    "declared_vs_observed struct<policy_links:array<struct<text:string,href:string>>,meta_tags:array<struct<name:string,content:string>>>, "
    f"observed_behavior struct<network_summary:struct<total_requests:int,third_party_requests:int,third_party_domains:array<string>>,cookies:struct<total:int,third_party_count:int,all_cookies:array<{COOKIE}>>,fingerprinting_traps:struct<alarms_triggered:int,alarms:array<string>>,all_requests:array<struct<url:string,method:string,third_party:boolean,domain:string>>>, "
    "visual_evidence struct<interactable_elements:struct<total:int,consent_related_count:int>>"
)
LIST_A = "categories map<string,array<map<string,map<string,string>>>>"
REPORT = (
    "domain string, scan_date string, overall_score int, overall_verdict string, "
    "dimensions array<struct<dimension:string,verdict:string,score:int,confidence:double,severity:string,policy_claim:string,behavioral_evidence:string,discrepancy_type:string,"
    "breach:struct<regulation:string,article:string,requirement_text:string>,retrieved_articles:array<struct<regulation:string,article:string>>,rule_text:string>>"
)
RECORD = (
    "domain string, sector string, jurisdiction string, status string, requests int, ui_elements int, policies_found int, overall_score int, overall_verdict string, n_dimensions int, "
    "n_fail int, n_partial int, n_pass int, n_not_addressed int, grounding_rate double, dims_with_issues int, seconds double, notes string, issues array<string>"
)
ANNOTATION = "domain string, dimension string, legal_requirement string, observed_behaviour string, policy_excerpt string, human_verdict string, annotator_notes string"


def json_documents(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """One document a file; scan is the file's name without its ending."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").json(path)
    return df.withColumn("scan", F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:_telemetry)?\.[^.]+$", 1))


def har(spark, path: str) -> DataFrame:
    return json_documents(spark, path, HAR)


def telemetry(spark, path: str) -> DataFrame:
    return json_documents(spark, path, TELEMETRY)


def tracker_list_a(spark, path: str) -> DataFrame:
    """(domain, category, pos); values that are not lists are left out. pos is the place in the file: of category, service, home and list."""
    raw = spark.read.schema(LIST_A).option("multiLine", True).json(path)
    categories = raw.select(F.posexplode(F.map_entries("categories")).alias("p0", "c"))
    services = categories.select("p0", F.col("c.key").alias("category"), F.posexplode("c.value").alias("p1", "s"))
    named = services.select("p0", "p1", "category", F.posexplode(F.map_entries("s")).alias("p2", "homes"))
    homes = named.select("p0", "p1", "p2", "category", F.posexplode(F.map_entries("homes.value")).alias("p3", "home")).where(F.startswith("home.value", F.lit("[")))
    listed = homes.select("p0", "p1", "p2", "p3", "category", F.posexplode(F.from_json("home.value", "array<string>")).alias("p4", "domain"))
    return listed.select("domain", "category", F.array("p0", "p1", "p2", "p3", "p4").alias("pos"))


def tracker_list_b(spark, path: str) -> DataFrame:
    return spark.read.text(path)


def whole_texts(spark, path: str) -> DataFrame:
    """(file, text) of each file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("text"))


def pdf_files(spark, path: str, to_text) -> DataFrame:
    """(file, text) of PDF files by a caller's function from bytes to text, in Arrow batches; no PDF library comes with this."""

    def run(batches):
        for b in batches:
            texts = [None if c is None else to_text(c) for c in b.column("content").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("file"), pa.array(texts, pa.string())], names=["file", "text"])

    files = spark.read.format("binaryFile").load(path).select(F.col("_metadata.file_name").alias("file"), "content")
    return files.mapInArrow(run, "file string, text string")


def sites(spark, path: str) -> DataFrame:
    raw = spark.read.schema("url string, sector string, jurisdiction string").option("comment", "#").option("ignoreLeadingWhiteSpace", True).option("ignoreTrailingWhiteSpace", True).csv(path)
    return raw.where(F.coalesce("url", F.lit("")) != "").select("url", F.coalesce("sector", F.lit("unknown")).alias("sector"), F.coalesce("jurisdiction", F.lit("?")).alias("jurisdiction"))


def reports(spark, path: str) -> DataFrame:
    """(domain, scan_date, overall_score, row) of reports' dimensions without those of dry runs."""
    df = spark.read.schema(REPORT).option("multiLine", True).json(path)
    return df.select("domain", "scan_date", "overall_score", F.explode("dimensions").alias("row")).where(F.col("row.verdict").isNull() | (F.col("row.verdict") != "DRY_RUN"))


def newest(spark, path: str, format: str = "text") -> DataFrame:
    """The name and time of the newest file."""
    m = spark.read.format(format).load(path).select(F.col("_metadata.file_path").alias("p"), F.col("_metadata.file_modification_time").alias("t")).distinct()
    return m.agg(F.max_by("p", F.struct("t", "p")).alias("file"), F.max("t").alias("modified"))


def records(spark, path: str) -> DataFrame:
    return spark.read.schema(RECORD).option("multiLine", True).json(path)


def annotations(spark, path: str, labels: list[str]) -> DataFrame:
    """Annotated rows: blank labels and unknown ones are left out, case and spaces don't count."""
    raw = spark.read.schema(ANNOTATION).option("header", True).option("multiLine", True).option("escape", '"').csv(path)
    return raw.withColumn("human", F.upper(F.trim("human_verdict"))).where(F.col("human").isin(labels))


def policy_map(spark, path: str) -> DataFrame:
    """(domain, host): keys whose value is a list; comments are strings and left out."""
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", "map<string,string>").alias("m"))
    pairs = raw.select(F.explode("m").alias("domain", "v")).where(F.startswith("v", F.lit("[")))
    return pairs.select("domain", F.explode(F.from_json("v", "array<string>")).alias("host"))


def chunks(spark, path: str) -> DataFrame:
    """The table of legal chunks with their vectors."""
    return spark.read.schema("chunk_id bigint, text string, regulation string, jurisdiction string, article string, requirement_type string, severity string, source_file string, embedding array<float>").parquet(path)


#: Sitemaps of sitemaps are followed so far.
SITEMAP_DEPTH = 2


def sitemap_links(bodies: DataFrame, tokens: list[str]) -> DataFrame:
    """(url, loc): addresses in fetched sitemaps, (url, body), that hold one of the tokens."""
    locs = bodies.select("url", F.explode(F.regexp_extract_all("body", F.lit(LOC), 1)).alias("loc"))
    return locs.where(any_of(F.lower("loc"), tokens))


def sitemap_pages(roots: DataFrame, bodies: DataFrame, tokens: list[str], depth: int = SITEMAP_DEPTH) -> DataFrame:
    """(host, loc): addresses of trusted hosts that hold a token, in a host's sitemaps and those that they name, depth levels down.

    roots: (host, sitemap); bodies: (url, body) of all that was fetched. A
    level is an equi-join with the bodies.
    """
    pages, level = [], roots.select("host", F.col("sitemap").alias("url")).distinct()
    for _ in range(depth + 1):
        read = level.join(bodies, "url").select("host", F.col("body").rlike("(?i)<sitemapindex").alias("is_index"), F.explode(F.regexp_extract_all("body", F.lit(LOC), 1)).alias("loc"))
        pages.append(read.where(~F.col("is_index")).select("host", "loc"))
        level = read.where("is_index").select("host", F.col("loc").alias("url")).distinct()
    found = reduce(DataFrame.unionByName, pages).distinct()
    return found.where(any_of(F.lower("loc"), tokens) & is_trusted(F.col("host"), url_host(F.col("loc"))))


def robots_sitemaps(bodies: DataFrame, usual: tuple[str, ...] = ("/sitemap.xml", "/sitemap_index.xml", "/sitemap-index.xml", "/sitemaps.xml")) -> DataFrame:
    """(origin, sitemap): those that robots files, (origin, body), name; else the usual places."""
    named = F.regexp_extract_all("body", F.lit(r"(?im)^\s*sitemap:\s*(\S+)"), 1)
    some = F.array(*(F.concat("origin", F.lit(u)) for u in usual))
    return bodies.select("origin", F.explode(F.when(F.size(named) > 0, named).otherwise(some)).alias("sitemap"))
