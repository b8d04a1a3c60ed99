"""What the operators of this subpackage share: the shared work folder, staged tables, word patterns."""

from __future__ import annotations

import ctypes
import tempfile
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: a word is a run of anything but a space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
#: A word with the separators before it; joined, such matches give back the text without its tail of separators.
WORD_WITH_GAP = r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ASCII_LOWER = bytes.maketrans(UPPER.encode(), LOWER.encode())


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir. Where it is unset, a temporary one, in local mode only; on a cluster an error."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not at:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        at = "file://" + tempfile.mkdtemp(prefix="quern-shared-")
        spark.sparkContext.setCheckpointDir(at)
        at = spark.sparkContext.getCheckpointDir()
    return at.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/quern-{name}-{uuid.uuid4().hex}"


#: Spark drops the shuffle files of a query at its end, not when the driver happens to collect its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def _written(df: DataFrame, path: str) -> DataFrame:
    """Writes df as Parquet and reads it back. Its shuffle files go as soon as it is written."""
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP)
    conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        conf.set(_CLEANUP, before)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df: DataFrame, name: str) -> DataFrame:
    """Writes df as a Parquet table in the shared folder and reads it back: cuts lineage, survives lost executors."""
    return _written(df, fresh_path(df.sparkSession, name))


class Scratch:
    """Staged tables that an operator needs until its result is staged itself; drop() removes them from the shared folder, all or those named."""

    def __init__(self, spark: SparkSession):
        self._spark, self._tables = spark, []

    def stage(self, df: DataFrame, name: str) -> DataFrame:
        path = fresh_path(self._spark, name)
        self._tables.append((None, path))
        self._tables[-1] = (_written(df, path), path)
        return self._tables[-1][0]

    def drop(self, *tables: DataFrame) -> None:
        jvm = self._spark.sparkContext._jvm
        gone = [x for x in self._tables if not tables or any(x[0] is t for t in tables)]
        for _, name in gone:
            path = jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(self._spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
        self._tables = [x for x in self._tables if all(x is not g for g in gone)]


#: Rows of a table with one row per key (100 bytes or so) that may be broadcast; more are joined by shuffles.
BROADCAST_KEYS = 1 << 17
#: A key is hot if more than one of so many rows has it, so at most that many keys are; and how many parts a hot key's rows are dealt over.
HOT_ONE_IN, HOT_PARTS = 1000, 64


def join_by_key(rows: DataFrame, keyed: DataFrame, key: str, n: str) -> DataFrame:
    """rows joined left with keyed: a staged table with one row per key, of which column n says how many of rows have it.

    A small table is broadcast. Otherwise both sides are shuffled, and the rows of hot keys are dealt over parts, to
    each of which the key's one row of the table is copied.
    """
    size, total = keyed.agg(F.count(F.lit(1)), F.sum(n)).first()
    if size <= BROADCAST_KEYS:
        return rows.join(F.broadcast(keyed), key, "left")
    hot = F.broadcast(keyed.filter(F.col(n) * HOT_ONE_IN > total).select(key, F.lit(True).alias("_hot")))  # HOT_ONE_IN rows at most
    part = F.when(F.col("_hot"), F.pmod(F.monotonically_increasing_id(), F.lit(HOT_PARTS))).otherwise(0).cast("int")
    every = F.explode(F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(HOT_PARTS - 1))).otherwise(F.array(F.lit(0))))
    left = rows.join(hot, key, "left").withColumn("_part", part).drop("_hot")
    right = keyed.join(hot, key, "left").withColumn("_part", every).drop("_hot")
    return left.join(right, [key, "_part"], "left").drop("_part")


def small_batches(spark: SparkSession, rows: int = 512, size: str = "8m") -> None:
    """Arrow batches of few rows and bytes, so that very long texts don't add up in a Python worker."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def give_back() -> None:
    """Returns a worker's freed memory to the system at the end of a task, where the C library can; workers outlive stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def word_count(text: Column) -> Column:
    """Number of words of the whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_crc32(id_col: Column) -> Column:
    """crc32 of the id written as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))
