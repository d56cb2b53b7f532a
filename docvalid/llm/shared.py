"""Tables, columns and written intermediate tables that the operators share."""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java's pattern for what separates words: space and 0x09-0x0D.
SEPARATORS = r"[\x20\x09-\x0D]+"
BATCH_ROWS = 2000
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

_written: dict[str, SparkSession] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """Lets Arrow hand over at most BATCH_ROWS rows at once, which may be long texts, if the session says nothing less."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def tidy(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run, after which a worker gives freed memory back: Spark keeps its workers for later tasks."""

    def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return tidied


def give_back() -> None:
    """Gives memory that this process has freed back to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except AttributeError:  # not glibc
        return


def plain(df: DataFrame, **columns: str | Column) -> DataFrame:
    """Only the named columns, under names of our own: others, and those that clash with ours, are gone."""
    small_batches(df.sparkSession)
    return df.select(*[(df[f"`{c}`"] if isinstance(c, str) else c).alias(name) for name, c in columns.items()])


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share; one of our own only on a single machine that names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    folder = "file://" + tempfile.mkdtemp(prefix="docvalid-")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def written(df: DataFrame, name: str) -> DataFrame:
    """df as a Parquet table in the shared folder: lineage ends there, and lost executors cost nothing."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docvalid-{uuid.uuid4().hex}-{name}"
    df.write.parquet(path)
    _written[path] = spark
    return spark.read.schema(df.schema).parquet(path)


def settled(df: DataFrame, name: str) -> DataFrame:
    """written, whose shuffle files go as soon as the table stands, not when the driver next collects its garbage."""
    conf, before = df.sparkSession.conf, df.sparkSession.conf.get(CLEANUP, None)
    conf.set(CLEANUP, "true")
    try:
        return written(df, name)
    finally:
        conf.unset(CLEANUP) if before is None else conf.set(CLEANUP, before)


def forget(spark: SparkSession) -> None:
    """Removes the tables that ``written`` made in this session; frames that read them end with it."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for path in [p for p, s in _written.items() if s is spark]:
        at = jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
        del _written[path]


@atexit.register
def _forget_all() -> None:
    for spark in list(_written.values()):
        try:
            forget(spark)
        except Exception:  # the JVM has ended before us; its session's tables stay
            return


def quick_partitions(spark: SparkSession, rows: int, each: int, least: int = 1) -> int:
    """So many partitions that each gets about ``each`` rows."""
    return max(least, -(-rows // max(1, each)))


def word_count(text: Column) -> Column:
    """Number of maximal runs outside space and 0x09-0x0D; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
