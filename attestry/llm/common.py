"""What the corpus operators share: table access, staged tables, text rules."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of code points other than the ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"

#: Rows in one Arrow batch, and bytes of text after which it ends: rows are
#: whole documents, so 10,000 of them could fill a Python worker.
BATCH_ROWS, BATCH_BYTES = 1000, 8 << 20
#: Tables up to so many bytes are sent to all executors.
BROADCAST_BYTES = 32 << 20


def session(spark: SparkSession) -> SparkSession:
    """Set the size of Arrow batches, which Spark takes from the session only."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return session(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share.

    A cluster names it in spark.checkpoint.dir. Only where that is unset and
    all runs in one process, as in tests, a local temporary folder takes its
    place.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        own = tempfile.mkdtemp(prefix="attestry-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
        sc.setCheckpointDir(own)
    return sc.getCheckpointDir().rstrip("/")


def _file_system(spark: SparkSession, path: str):
    """The JVM's path and its file system, whichever store Spark can reach."""
    sc = spark.sparkContext
    at = sc._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(sc._jsc.hadoopConfiguration())


def fresh_path(spark: SparkSession, label: str) -> str:
    """A new path in the application's part of the shared folder, which is deleted when the application ends."""
    own = f"{shared_dir(spark)}/attestry-{spark.sparkContext.applicationId}"
    at, files = _file_system(spark, own)
    if not files.exists(at):
        files.mkdirs(at)
        files.deleteOnExit(at)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it back.

    This cuts lineage: a lost executor costs the tasks it was running and not
    the steps before, and a table that is used twice is computed once.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._staged_at = path
    return out


def unstage(*tables: DataFrame) -> None:
    """Delete staged tables that nothing will read again."""
    for t in tables:
        at, files = _file_system(t.sparkSession, t._staged_at)
        files.delete(at, True)


def broadcast_if_small(staged: DataFrame, row_bytes: Column | int = 16) -> DataFrame:
    """A staged table, sent to all executors if its rows add up to BROADCAST_BYTES at most; else joined by exchange."""
    total = staged.agg(F.sum(row_bytes if isinstance(row_bytes, Column) else F.lit(row_bytes))).first()[0] or 0
    return F.broadcast(staged) if total <= BROADCAST_BYTES else staged.hint("merge")


def text_column(df: DataFrame, text_col: str = "text") -> Column:
    """The text, with null as the empty text."""
    return F.coalesce(df[text_col].cast("string"), F.lit(""))


def free_name(df: DataFrame, wanted: str) -> str:
    """A column name that df does not have yet."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = f"_{wanted}"
    return wanted


def texts_of(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The batch's texts; null reads as the empty text."""
    return ["" if t is None else t for t in batch.column(name).to_pylist()]


Batches = Iterator[pa.RecordBatch]


def _one_core() -> None:
    """A task has one core: no threads beside it, whose heaps would stay. Memory comes from where _give_back can return it to."""
    pa.set_cpu_count(1)
    pa.set_memory_pool(pa.system_memory_pool())


def _give_back() -> None:
    """Return to the system what a worker's task has freed: workers stay, and an executor's memory is counted with them."""
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def mapped(df: DataFrame, function: Callable[[Batches], Batches], schema) -> DataFrame:
    """df.mapInArrow(function, schema), whose workers keep no memory after a task."""

    def run(batches: Batches) -> Batches:
        _one_core()
        yield from function(batches)
        _give_back()

    return df.mapInArrow(run, schema)


class Memo(dict):
    """What a worker remembers of its last `limit` to twice as many different keys.

    A subclass says how to compute a value. When the younger half is full it
    becomes the older one; what is asked for again moves back.
    """

    def __init__(self, limit: int, longest: int = 64):
        super().__init__()
        self.limit, self.longest, self.older = limit, longest, {}

    def compute(self, key: str):
        raise NotImplementedError

    def __missing__(self, key: str):
        got = self.older.get(key)
        if got is None:
            got = self.compute(key)
        if len(key) <= self.longest:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[key] = got
        return got
