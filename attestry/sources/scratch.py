"""Written intermediate tables: a folder that the driver and all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def file_system(spark: SparkSession, path: str):
    """The JVM's path and its file system, whichever store Spark can reach."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = file_system(spark, path)
    return files.exists(at)


def fresh_folder(spark: SparkSession, label: str) -> str:
    """A new path under spark.checkpoint.dir that goes when the application ends; in one process, as in tests, a temporary folder may take its place."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    path = f"{named.rstrip('/')}/attestry-{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    at, files = file_system(spark, path)
    files.mkdirs(at)
    files.deleteOnExit(at)
    return path


def written(df: DataFrame, label: str) -> DataFrame:
    """df, written once and read again: what reads it twice sees the same rows, and a lost executor costs its running tasks."""
    path = f"{fresh_folder(df.sparkSession, label)}/table"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
