"""Choosing policy documents among links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def best_and_others(candidates: DataFrame, keys: list[str], most: int = 50) -> DataFrame:
    """The best candidate of each key (ties keep their order) and the others in order, without the best one's address.

    candidates: keys, href, score, pos. Ranks are limited before lists are
    gathered, so a key's list is short however many candidates it has.
    """
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "pos")
    ranked = candidates.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most + 1)
    others = F.transform(F.sort_array(F.collect_list(F.when(F.col("rank") > 1, F.struct("rank", "href")))), lambda x: x["href"])
    out = ranked.groupBy(*keys).agg(F.max(F.when(F.col("rank") == 1, F.col("href"))).alias("best"), F.max(F.when(F.col("rank") == 1, F.col("score"))).alias("best_score"), others.alias("_o"))
    return out.select(*keys, "best", "best_score", F.filter("_o", lambda x: x != F.col("best")).alias("others"))


def first_success(candidates: DataFrame, keys: list[str], ok: str = "ok") -> DataFrame:
    """The first candidate of each key, by pos, that succeeded; null if none did."""
    return candidates.groupBy(*keys).agg(F.min_by(F.when(F.col(ok), F.col("href")), F.when(F.col(ok), F.col("pos"))).alias("href"), F.count("*").alias("tried"))


def hub_pages(anchors: DataFrame, keys: list[str], policy_link: Column, most: int = 5) -> DataFrame:
    """keys and links of pages with more than so many policy links: they lead to policies and are none."""
    return anchors.where(policy_link).groupBy(*keys).agg(F.count("*").alias("links")).where(F.col("links") > most)


def pooled(primary: DataFrame, extra: DataFrame, keys: list[str], prepend: bool = False) -> DataFrame:
    """Both lists with unseen addresses of the extra one; a prepended list comes first, in reverse order of discovery."""
    first, second = (extra.withColumn("pos", -F.col("pos")), primary) if prepend else (primary, extra)
    every = first.withColumn("src", F.lit(0)).unionByName(second.withColumn("src", F.lit(1)))
    w = Window.partitionBy(*keys, "href").orderBy("src", "pos")
    return every.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def choose(choices: DataFrame, candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Choices with the attributes of their candidate, or those of an address that was made up."""
    c = candidates.select(*keys, "href", "score", "source")
    return choices.join(c, [*keys, "href"], "left").withColumns({"score": F.coalesce("score", F.lit(0)), "source": F.coalesce("source", F.lit("choice"))})
