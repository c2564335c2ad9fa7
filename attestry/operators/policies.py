"""Policy documents: which apply to a site, their text for a prompt, and the choice among links and answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import text as X
from attestry.functions import urls as U
from attestry.functions import vocab

#: Characters of one policy document in a prompt; what is cut off leaves the mark.
MOST_CHARS = 60_000
CUT_MARK = "\n[... truncated ...]"
NO_POLICY = (
    "No policy text could be fetched for this site. That may be a failure of the fetch, so its absence proves nothing: "
    "treat the policy as unavailable, keep confidence at 0.6 or below, and leave policy_claim and discrepancy_type null."
)
KINDS = ("privacy", "cookie")


def policy_text(files: DataFrame, sites: DataFrame | None = None, most: int = MOST_CHARS, notice: str = NO_POLICY) -> DataFrame:
    """(site, policy_text, n_files): the files of a site under their names, in order of pos, each cut at most characters.

    files: (site, pos, name, text); a null text is empty. Sites of the second
    table that have no file have the notice. A site has a few files, so a row
    is a few times most characters.
    """
    text = F.coalesce("text", F.lit(""))
    cut = F.when(F.length(text) > most, F.concat(F.substring(text, 1, most), F.lit(CUT_MARK))).otherwise(text)
    block = F.concat(F.lit("--- "), F.col("name"), F.lit(" ---\n"), cut)
    blocks = F.transform(F.sort_array(F.collect_list(F.struct("pos", "name", block.alias("block")))), lambda x: x["block"])
    out = files.groupBy("site").agg(F.array_join(blocks, "\n\n").alias("policy_text"), F.count("*").alias("n_files"))
    if sites is None:
        return out
    wide = sites.select("site").distinct().join(out, "site", "left")
    return wide.select("site", F.coalesce("policy_text", F.lit(notice)).alias("policy_text"), F.coalesce("n_files", F.lit(0)).alias("n_files"))


def site_stem(domain: Column) -> Column:
    return F.substring_index(F.replace(domain, F.lit("www."), F.lit("")), ".", 1)


#: Stems meet names at a run of so many characters, or all of a shorter stem.
GRAM = 3


def grams(text: Column, n: Column | int) -> Column:
    """The different runs of n characters."""
    n = n if isinstance(n, Column) else F.lit(n)
    runs = F.transform(F.sequence(F.lit(1), F.length(text) - n + 1), lambda i: F.substring(text, i, n))
    return F.when(F.length(text) >= n, F.array_distinct(runs)).otherwise(F.array().cast("array<string>"))


def holding(stems: DataFrame, names: DataFrame) -> DataFrame:
    """(stem, name) where the name holds the stem; stems: (stem), names: (name).

    Names are listed by their runs of 1 to GRAM characters, as many rows as
    they have characters. Each stem is looked up at that of its runs which the
    fewest names hold, and what it meets there is compared.
    """
    listed = names.select("name").distinct().select("name", F.explode(F.concat(*(grams(F.col("name"), n) for n in range(1, GRAM + 1)))).alias("gram"))
    held_by = listed.groupBy("gram").agg(F.count("*").alias("n"))
    asked = stems.where(F.col("stem") != "").select("stem").distinct()
    own = asked.select("stem", F.explode(grams(F.col("stem"), F.least(F.length("stem"), F.lit(GRAM)))).alias("gram")).join(held_by, "gram", "left")
    rarest = own.groupBy("stem").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)), F.col("gram"))).alias("gram"))
    return rarest.join(listed, "gram").where(F.contains("name", F.col("stem"))).select("stem", "name")


def find_policies(sites: DataFrame, files: DataFrame, mapping: DataFrame) -> DataFrame:
    """(domain, file, tier): the files of the first tier that has any.

    Tier 1 are the privacy and cookie policy named after the domain, tier 2
    those of hosts that mapping, (domain, host), names for it, tier 3 all
    whose name holds the domain's stem. Tiers 1 and 2 are equi-joins, tier 3
    is one at the stem's rarest run of characters.
    """
    named = files.select("file").distinct()

    def of(df, tier):
        both = df.select("domain", "host", F.explode(F.array(*map(F.lit, KINDS))).alias("kind"))
        return both.select("domain", F.concat("host", F.lit("_"), "kind", F.lit("_policy.md")).alias("file"), F.lit(tier).alias("tier"))

    domains = sites.select("domain").distinct()
    own = of(domains.withColumn("host", F.col("domain")), 1).join(named, "file", "left_semi")
    mapped = of(domains.join(mapping, "domain"), 2).join(named, "file", "left_semi")
    stems = domains.withColumn("stem", site_stem(F.col("domain")))
    held = holding(stems, named.where(F.endswith("file", F.lit("_policy.md"))).select(F.col("file").alias("name")))
    by_stem = stems.join(held, "stem").select("domain", F.col("name").alias("file"), F.lit(3).alias("tier"))
    every = own.unionByName(mapped).unionByName(by_stem).distinct()
    first = Window.partitionBy("domain")
    return every.withColumn("_first", F.min("tier").over(first)).where(F.col("tier") == F.col("_first")).drop("_first")


def is_marketing(category: Column, score: Column, href: Column, text: Column) -> Column:
    """Whether a candidate is a marketing page: of no special kind, of no score, and worded so."""
    words = F.lower(F.concat(href, F.lit(" "), F.coalesce(text, F.lit(""))))
    return (category == "other_policy") & (score == 0) & U.any_of(words, vocab.MARKETING_WORDS)


def deep_link_score(href: Column, text: Column, category_words: list[str]) -> Column:
    """score_url with bonuses for links to a full document."""
    low = F.lower(F.coalesce(text, F.lit("")))
    full = U.any_of(low, vocab.FULL_WORDS) | U.any_of(F.lower(href), vocab.FULL_WORDS)
    more = F.contains(low, F.lit(vocab.MORE_WORDS)) & U.any_of(low, category_words)
    return U.score_url(href) + F.when(full, 50).otherwise(0) + F.when(more, 50).otherwise(0)


def best_deep_link(found: DataFrame, keys: list[str], category_words: list[str]) -> DataFrame:
    """keys with the best link, href, of a thin page; the first of equals. found: keys, href, text, pos, and the site's host.

    Links to hosts that are not trusted and to log-in pages don't count.
    """
    ok = found.where(U.is_trusted(F.col("host"), U.url_host(F.col("href"))) & ~U.is_auth_url(F.col("href")))
    scored = ok.withColumn("score", deep_link_score(F.col("href"), F.col("text"), category_words))
    best = F.max_by(F.struct("href", "score"), F.struct("score", -F.col("pos")))
    return scored.groupBy(*keys).agg(best.alias("b")).select(*keys, "b.href", "b.score")


def main_response(responses: DataFrame, wanted: DataFrame, key: str = "scan") -> DataFrame:
    """key, url and how it was found: the last response of the wanted address, else the first response.

    responses: (key, pos, url); wanted: (key, final_url).
    """
    same = F.col("url") == F.col("final_url")
    joined = responses.join(wanted, key)
    out = joined.groupBy(key).agg(F.max_by(F.when(same, F.col("url")), F.when(same, F.col("pos"))).alias("exact"), F.min_by("url", "pos").alias("first"))
    return out.select(key, F.coalesce("exact", "first").alias("url"), F.when(F.col("exact").isNotNull(), "final_url").otherwise("fallback_first_document").alias("found_by"))


def crude_body(raw: Column) -> Column:
    """What stands in a fence at the text's beginning, without the fence's language; else the text."""
    text = F.trim(raw)
    inner = F.trim(F.ltrim(F.get(F.split(text, "```"), 1), F.lit("json")))
    return F.when(F.startswith(text, F.lit("```")), inner).otherwise(text)


def picked_urls(raw: Column) -> Column:
    """map<kind, struct<url, reason>> of a model's choice: only entries with an address count."""
    parsed = F.from_json(crude_body(raw), "map<string,string>")
    entry = lambda k: F.from_json(F.try_element_at(parsed, F.lit(k)), "struct<url:string,reason:string>")
    pairs = [F.when(F.coalesce(entry(k)["url"], F.lit("")) != "", F.struct(F.lit(k).alias("key"), F.struct(entry(k)["url"].alias("url"), F.coalesce(entry(k)["reason"], F.lit("")).alias("reason")).alias("value"))) for k in ("privacy_policy", "cookie_policy")]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def checked_documents(raw: Column) -> Column:
    """map<kind, struct<looks_correct, reason>> of a model's judgement: only entries that give one count."""
    parsed = F.from_json(crude_body(raw), "map<string,string>")
    entry = lambda k: F.from_json(F.try_element_at(parsed, F.lit(k)), "struct<looks_correct:boolean,reason:string>")
    pairs = [F.when(entry(k)["looks_correct"].isNotNull(), F.struct(F.lit(k).alias("key"), F.struct(entry(k)["looks_correct"].alias("looks_correct"), F.coalesce(entry(k)["reason"], F.lit("")).alias("reason")).alias("value"))) for k in ("privacy_policy", "cookie_policy")]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull()))


def compact_telemetry(telemetry: DataFrame, with_tags: bool = True) -> DataFrame:
    """(scan, payload): the fields of telemetry that a model is shown, as JSON; requests and cookies themselves are left out."""
    declared = [F.col("declared_vs_observed.policy_links").alias("policy_links")] + ([F.col("declared_vs_observed.meta_tags").alias("meta_tags")] if with_tags else [])
    parts = [F.col("meta"), F.struct(*declared).alias("declared_vs_observed")]
    if with_tags:
        cookies = F.struct(F.col("observed_behavior.cookies.total").alias("total"), F.col("observed_behavior.cookies.third_party_count").alias("third_party_count"))
        parts.append(F.struct(F.col("observed_behavior.network_summary").alias("network_summary"), cookies.alias("cookies")).alias("observed_behavior"))
    return telemetry.select("scan", F.to_json(F.struct(*parts)).alias("payload"))


def compact_text(text: Column, most: int = 40_000) -> Column:
    return F.substring(text, 1, most)


def embedded_cookie_policy(privacy: Column, cookie: Column, thin: int = 300) -> Column:
    """The cookie section of the privacy policy, where the cookie policy is missing or thin."""
    due = cookie.isNull() | (X.word_count(cookie) < thin)
    return F.when(due, X.cookie_section(privacy))
