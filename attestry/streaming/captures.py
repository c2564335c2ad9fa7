"""An extension: captures as a file stream, so that a run takes up what came since the last one."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from attestry.functions.urls import etld1, url_host
from attestry.sources.scratch import exists, file_system

#: What a row of counts is of.
KEY = ("scan", "etld1", "hour")


def request_counts(spark: SparkSession, folder: str, schema: str = "scan string, url string, ts timestamp") -> DataFrame:
    """Requests by scan, registrable domain and hour; rows over a day late don't count any more."""
    rows = spark.readStream.schema(schema).json(folder)
    keyed = rows.withColumn("etld1", etld1(url_host(F.col("url")))).withWatermark("ts", "1 day")
    return keyed.groupBy("scan", "etld1", F.window("ts", "1 hour")).agg(F.count("*").alias("n"))


def run_available(counts: DataFrame, out: str, checkpoint: str) -> None:
    """Process the files that are there and stop; the checkpoint remembers them."""

    def write(batch: DataFrame, epoch: int) -> None:
        batch.select("scan", "etld1", F.col("window.start").alias("hour"), "n").write.mode("overwrite").parquet(f"{out}/epoch={epoch}")

    counts.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def _numbers(spark: SparkSession, folder: str, name: str) -> list[int]:
    """The numbers n of the complete tables folder/name=n."""
    if not exists(spark, folder):
        return []
    at, files = file_system(spark, folder)
    found = [x.getPath() for x in files.listStatus(at) if x.getPath().getName().startswith(f"{name}=")]
    return sorted(int(p.getName().split("=")[1]) for p in found if exists(spark, f"{p}/_SUCCESS"))


def counts(spark: SparkSession, out: str) -> DataFrame:
    """(scan, etld1, hour, n, epoch): the last count of each hour, from the newest compacted table and the epochs after it.

    An hour's count is written anew, as a total, by each epoch that adds to
    it, so the one of the highest epoch counts.
    """
    until = (_numbers(spark, f"{out}/compacted", "until") or [None])[-1]
    epochs = [n for n in _numbers(spark, out, "epoch") if until is None or n > until]
    schema = "scan string, etld1 string, hour timestamp, n bigint"
    tables = [spark.read.schema(schema).parquet(f"{out}/epoch={n}").withColumn("epoch", F.lit(n).cast("bigint")) for n in epochs]
    if until is not None:
        tables.append(spark.read.schema(f"{schema}, epoch bigint").parquet(f"{out}/compacted/until={until}"))
    every = spark.createDataFrame([], f"{schema}, epoch bigint")
    for t in tables:
        every = every.unionByName(t)
    return every.groupBy(*KEY).agg(F.max_by("n", "epoch").alias("n"), F.max("epoch").alias("epoch"))


def compact(spark: SparkSession, out: str) -> int | None:
    """Write the last counts up to the newest epoch as one table, and return that epoch; None without any.

    It is safe to repeat and to break off: a table counts once Spark has
    marked it complete, the epochs stay, and one that is compacted already is
    not read again. Between compactions a reader opens as many tables as there
    were epochs since.
    """
    epochs, done = _numbers(spark, out, "epoch"), _numbers(spark, f"{out}/compacted", "until")
    if epochs and (not done or epochs[-1] > done[-1]):
        counts(spark, out).write.mode("overwrite").parquet(f"{out}/compacted/until={epochs[-1]}")
    return epochs[-1] if epochs else None
