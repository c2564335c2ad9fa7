"""Tracker lists, classification of hosts, and the profiling rule."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from attestry.functions import vocab
from attestry.functions.urls import etld1


def list_a(raw: DataFrame, position: str = "pos") -> DataFrame:
    """(domain, category) of category lists with a position; of several categories the last counts."""
    return raw.groupBy(etld1(F.col("domain")).alias("domain")).agg(F.max_by("category", position).alias("category"))


def list_b(lines: DataFrame) -> DataFrame:
    """(domain) of text lines; blank ones and comments are skipped."""
    line = F.trim("value")
    return lines.where((line != "") & ~F.startswith(line, F.lit("#"))).select(etld1(line).alias("domain")).distinct()


def builtin(spark, domains: list[str] = vocab.BUILTIN_TRACKERS) -> DataFrame:
    return spark.createDataFrame([(d,) for d in domains], "domain string")


def tracker_database(patterns: DataFrame, pattern_domains: DataFrame, profiling: list[str] = vocab.PROFILING_CATEGORIES_B) -> DataFrame:
    """Sorted registrable domains of a tracker database whose category is unknown or profiling; none at all is an error.

    patterns: (pattern, category, domains array); pattern_domains: (domain, pattern).
    """
    own = patterns.select("pattern", F.explode("domains").alias("domain"))
    every = own.unionByName(pattern_domains.select("pattern", "domain")).distinct()
    kept = every.join(patterns.select("pattern", "category"), "pattern", "left").where(F.col("category").isNull() | F.col("category").isin(profiling))
    out = kept.select(etld1(F.col("domain")).alias("domain")).where("domain <> ''").distinct()
    if out.isEmpty():
        raise ValueError("the tracker database has no domain of a profiling category")
    return out.orderBy("domain")


def with_category(rows: DataFrame, a: DataFrame, b: DataFrame, builtin_domains: DataFrame, host: str = "etld1") -> DataFrame:
    """Adds category: list A's, else 'tracker' if list B or the built-in list has the domain, else null."""
    other = b.select("domain").union(builtin_domains.select("domain")).distinct().select(F.col("domain").alias("_b"))
    joined = rows.join(a.select(F.col("domain").alias("_a"), F.col("category").alias("_cat")), F.col(host) == F.col("_a"), "left").join(other, F.col(host) == F.col("_b"), "left")
    return joined.withColumn("category", F.coalesce("_cat", F.when(F.col("_b").isNotNull(), F.lit("tracker")))).drop("_a", "_b", "_cat")


def tracker_domains(a: DataFrame, b: DataFrame, builtin_domains: DataFrame, profiling: list[str] = vocab.PROFILING_CATEGORIES_A) -> DataFrame:
    """(mode, domain): the domains that count as trackers under each mode.

    intersection: in a profiling category of A and in B; single: in the one
    list there is; builtin: the bundled list.
    """
    pa, pb = a.where(F.col("category").isin(profiling)).select("domain"), b.select("domain")
    both = pa.join(pb, "domain", "left_semi")
    tag = lambda df, mode: df.distinct().select(F.lit(mode).alias("mode"), "domain")
    return tag(both, "intersection").unionByName(tag(pa, "single_a")).unionByName(tag(pb, "single_b")).unionByName(tag(builtin_domains, "builtin"))


def mode(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: the mode that applies, by which lists have rows."""
    has = lambda df: df.limit(1).agg((F.count("*") > 0).alias("x"))
    return has(a).select(F.col("x").alias("a")).crossJoin(has(b).select(F.col("x").alias("b"))).select(F.when(F.col("a") & F.col("b"), "intersection").when(F.col("a"), "single_a").when(F.col("b"), "single_b").otherwise("builtin").alias("mode"))


def only_in_first(first: DataFrame, second: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of the first whose keys, nulls included, the second has not."""
    other = second.select(*(F.col(k).alias(f"_{k}") for k in keys)).distinct()
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return first.join(other, on, "left_anti")


def undeclared(observed: DataFrame, declared: DataFrame, site: str = "site", item: str = "item") -> DataFrame:
    """(site, item, discrepancy): what was observed and not declared."""
    gone = only_in_first(observed.select(site, item).distinct(), declared, [site, item])
    return gone.withColumn("discrepancy", F.lit("neglect"))


def keep_first(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key by the order, whose last column is unique."""
    return rows.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rank = 1").drop("_rank")
