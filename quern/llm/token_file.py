"""Token ids as Parquet list columns with delta-coded lists, small pages and bounded row groups.

Files are sorted by doc_id, and each has a row per document: doc_id, part (the file's number), local_start (ids before
it in the file), n_tokens, tokens. Page and row-group statistics of the first four columns let a reader fetch one
document, or all lengths, without the lists.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark import TaskContext
from pyspark.sql import functions as F

from quern.llm.common import fresh_path, give_back, small_batches
from quern.llm.encoding import crc, encoder

SCHEMA = "doc_id long, part int, local_start long, n_tokens long, tokens array<int>"
ROW_GROUP_BYTES, PAGE_BYTES, PAGE_ROWS = 32 << 20, 128 << 10, 2000
#: Bytes of text in a file at most, about; the session's number of shuffle partitions makes smaller ones.
FILE_BYTES = 256 << 20


def write_tokens(docs: DataFrame, path: str, vocabulary: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", row_group_bytes: int = ROW_GROUP_BYTES, file_bytes: int = FILE_BYTES) -> None:
    """Encodes every text (null: empty), appends end_id and writes the ids in ascending order of the ids of documents.

    Null ids come first; rows that repeat an id stand side by side, ordered by text. Files hold disjoint ranges of ids.
    """

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, at, end = TaskContext.get().partitionId(), 0, np.array([end_id], "<u4")
        for b in batches:
            ids = [part for x in encoder(vocabulary).encode(b.column(1)) for part in (x, end)]
            n = np.array([len(x) + 1 for x in ids[::2]], np.int64)
            ends = at + np.cumsum(n)
            offsets = np.concatenate([[0], ends - at]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([end[:0], *ids]).view("<i4")))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(np.full(len(n), part, np.int32)), pa.array(ends - n), pa.array(n), lists], names=["doc_id", "part", "local_start", "n_tokens", "tokens"])
            at = int(ends[-1]) if len(n) else at
        give_back()

    small_batches(docs.sparkSession, 2048, "4m")
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    files = -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // file_bytes)
    by = (files,) if files > int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")) else ()
    ordered = rows.repartitionByRange(*by, "doc_id").sortWithinPartitions("doc_id", "text")
    (
        ordered.mapInArrow(encode, SCHEMA)
        .write.option("parquet.writer.version", "PARQUET_2_0")
        .option("parquet.enable.dictionary", "true")
        .option("parquet.enable.dictionary#tokens.list.element", "false")  # the second version's writer then takes delta coding
        .option("parquet.block.size", str(row_group_bytes))
        .option("parquet.page.size", str(PAGE_BYTES))
        .option("parquet.page.row.count.limit", str(PAGE_ROWS))
        .option("compression", "uncompressed")  # delta-packed lists hardly shrink further
        .parquet(path)
    )


def read_tokens(spark: SparkSession, path: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """Documents with ids from low to high, or all; the bounds reach the row groups and pages."""
    df = spark.read.schema(SCHEMA).parquet(path)
    df = df if low is None else df.filter(F.col("doc_id") >= low)
    return df if high is None else df.filter(F.col("doc_id") <= high)


def read_lengths(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, part, local_start, n_tokens, without reading any list."""
    return spark.read.schema(SCHEMA).parquet(path).select("doc_id", "part", "local_start", "n_tokens")


def part_starts(spark: SparkSession, path: str) -> dict[int, int]:
    """The ids before each file: one number a file passes through the driver."""
    sizes = read_lengths(spark, path).groupBy("part").agg(F.sum("n_tokens").alias("n")).collect()
    starts, at = {}, 0
    for part, n in sorted((r["part"], r["n"]) for r in sizes):
        starts[part], at = at, at + n
    return starts


def digest_tokens(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of every document, from the lists in the files."""
    starts = part_starts(spark, path)

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column(3)
            values, offsets = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
            start = np.array([starts[p] for p in b.column(1).to_pylist()], np.int64) + b.column(2).to_numpy()
            sums = [crc(values[i:j]) for i, j in zip(offsets[:-1], offsets[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(start), pa.array(np.diff(offsets).astype(np.int64)), pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    small_batches(spark)
    return read_tokens(spark, path).select("doc_id", "part", "local_start", "tokens").mapInArrow(digest, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_and_digest(docs: DataFrame, vocabulary: str, end_id: int) -> DataFrame:
    """Writes docs in the file format in the shared folder and digests the files. No rows give no rows."""
    spark = docs.sparkSession
    path = fresh_path(spark, "tokens")
    write_tokens(docs, path, vocabulary, end_id)
    return digest_tokens(spark, path)
