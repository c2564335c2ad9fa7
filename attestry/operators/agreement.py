"""Agreement between human labels and the system's."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def _rate(n, d):
    return F.when(d > 0, n.cast("double") / d.cast("double")).otherwise(0.0)


def matched(annotated: DataFrame, reported: DataFrame, keys: list[str] = ("domain", "dimension")) -> DataFrame:
    """annotated, (keys, human), with system and matched: whether a report has a verdict on it. What has none is counted, not lost."""
    r = reported.select(*keys, F.col("verdict").alias("system"), F.lit(True).alias("_hit"))
    return annotated.join(r, list(keys), "left").withColumn("matched", F.coalesce("_hit", F.lit(False))).drop("_hit")


def agreement(pairs: DataFrame, by: list[str] = ()) -> DataFrame:
    """n, matches and their ratio. pairs: (human, system)."""
    n, m = F.count("*"), F.count_if(F.col("human") == F.col("system"))
    return pairs.groupBy(*by).agg(n.alias("n"), m.alias("matches"), F.round(_rate(m, n), 6).alias("ratio"))


def kappa(pairs: DataFrame, labels: list, by: list[str] = ()) -> DataFrame:
    """Cohen's kappa in one pass: 1 where chance alone agrees, 0 on no pairs."""
    n = F.count("*").cast("double")
    same = F.count_if(F.col("human") == F.col("system"))
    both = [(F.count_if(F.col("human") == v), F.count_if(F.col("system") == v)) for v in labels]
    counted = pairs.groupBy(*by).agg(n.alias("n"), same.alias("s"), *(c.alias(f"{'hs'[i]}{k}") for k, cs in enumerate(both) for i, c in enumerate(cs)))
    po = _rate(F.col("s"), F.col("n"))
    pe = sum((_rate(F.col(f"h{k}"), F.col("n")) * _rate(F.col(f"s{k}"), F.col("n")) for k in range(len(labels))), F.lit(0.0))
    value = F.when(F.col("n") == 0, 0.0).when(F.abs(1 - pe) < 1e-12, 1.0).otherwise((po - pe) / F.nullif(1 - pe, F.lit(0.0)))
    return counted.select(*by, F.col("n").cast("bigint").alias("n"), F.round(value, 6).alias("kappa"))


def prf(pairs: DataFrame, labels: list) -> DataFrame:
    """Per label: precision, recall, F1 (0 for an empty denominator) and both supports."""
    label = F.explode(F.array(*map(F.lit, labels))).alias("label")
    rows = pairs.select("human", "system", label)
    tp, h, s = F.count_if((F.col("human") == F.col("label")) & (F.col("system") == F.col("label"))), F.count_if(F.col("human") == F.col("label")), F.count_if(F.col("system") == F.col("label"))
    c = rows.groupBy("label").agg(tp.alias("tp"), h.alias("human_support"), s.alias("system_support"))
    p, r = _rate(F.col("tp"), F.col("system_support")), _rate(F.col("tp"), F.col("human_support"))
    return c.select("label", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"), "human_support", "system_support")


def macro_f1(scores: DataFrame) -> DataFrame:
    """The mean F1 of labels that either side has."""
    return scores.where((F.col("human_support") > 0) | (F.col("system_support") > 0)).agg(F.round(F.avg("f1"), 6).alias("macro_f1"))


def binary(pairs: DataFrame, positive: list) -> DataFrame:
    h, s = F.col("human").isin(positive), F.col("system").isin(positive)
    c = pairs.agg(F.count_if(h & s).alias("tp"), F.count_if(~h & s).alias("fp"), F.count_if(h & ~s).alias("fn"))
    p, r = _rate(F.col("tp"), F.col("tp") + F.col("fp")), _rate(F.col("tp"), F.col("tp") + F.col("fn"))
    return c.select("tp", "fp", "fn", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 6).alias("f1"))


def confusion(pairs: DataFrame, labels: list) -> DataFrame:
    return pairs.groupBy("human").agg(*(F.count_if(F.col("system") == v).alias(f"system_{v}") for v in labels))
