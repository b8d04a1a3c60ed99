"""Exact deduplication by skew-safe combining.

Rows are combined three times, and the full text is part of the key each time: within a partition, then within a
salted digest group, then over the salts. A group of any size thus sends at most one row per partition and salt.
Only digests of which two different texts exist (a SHA-256 collision) keep their text for the last join. Rows meet
their group's winner by digest; the rows of hot digests are dealt over parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, join_by_key, stage

SALTS = 16


def group_winners(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per distinct text: digest, body (null unless another text has this digest), keep_id, group_size."""
    base = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body"), (F.spark_partition_id() % salts).alias("salt"))
    keyed = base.withColumn("digest", F.sha2("body", 256))
    salted = keyed.groupBy("digest", "salt", "body").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("n"))
    merged = salted.repartition("digest").groupBy("digest", "body").agg(F.max("keep_id").alias("keep_id"), F.sum("n").alias("group_size"))
    variants = F.count(F.lit(1)).over(Window.partitionBy("digest"))
    return merged.withColumn("variants", variants).select("digest", F.when(F.col("variants") > 1, F.col("body")).alias("body"), "keep_id", "group_size")


def mark_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per input row: the id, keep_id, group_size, kept, text_sha256.

    Null text counts as empty. Of equal texts the row with the largest id stays (nulls are smallest); of rows that
    repeat that id and text, exactly one stays. Other columns of the input are not looked at. No rows give no rows.
    """
    scratch = Scratch(docs.sparkSession)
    winners = scratch.stage(group_winners(docs, id_col, text_col, salts), "dedup-winners")
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("body")).withColumn("digest", F.sha2("body", 256))
    plain = join_by_key(rows.select("id", "digest"), winners.filter(F.col("body").isNull()).drop("body"), "digest", "group_size")
    marks = plain.filter(F.col("group_size").isNotNull()).withColumn("body", F.lit(None).cast("string"))
    clashes = winners.filter(F.col("body").isNotNull())
    if not clashes.isEmpty():
        marks = marks.unionByName(rows.join(clashes, ["digest", "body"]))
    marks = scratch.stage(marks.withColumn("row", F.monotonically_increasing_id()), "dedup-marks")
    kept = F.col("id").eqNullSafe(F.col("keep_id"))
    firsts = scratch.stage(marks.filter(kept).groupBy("digest", "body", "id").agg(F.min("row").alias("row"), F.count(F.lit(1)).alias("n")), "dedup-firsts")
    if not firsts.filter("n > 1").isEmpty():  # rows are met by their number, so that no group gathers
        marks, kept = marks.join(firsts.select("row", F.lit(True).alias("first")), "row", "left"), F.coalesce("first", F.lit(False))
    out = stage(marks.select(F.col("id").alias(id_col), "keep_id", "group_size", kept.alias("kept"), F.col("digest").alias("text_sha256")), "dedup-result")
    scratch.drop()
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", salts: int = SALTS) -> DataFrame:
    """The rows of docs that stay, with all their columns.

    Only ids and digests of groups of two or more are joined back; where they are few, no text moves again.
    """
    key = lambda i, d: F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("null")), d)
    marks = mark_duplicates(docs, id_col, text_col, salts).filter("group_size > 1").select(key(F.col(id_col), F.col("text_sha256")).alias("_key"), "kept")
    touched = stage(marks.groupBy("_key").agg(F.max("kept").alias("stays"), F.count(F.lit(1)).alias("n")).filter("n > 1 or not stays"), "dedup-touched")
    body = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), key(F.col(id_col), F.sha2(body, 256)).alias("_key"))  # other columns can't clash
    met = join_by_key(rows, touched, "_key", "n")
    out = met.filter(F.col("n").isNull()).select("row.*")
    if touched.filter("stays").isEmpty():
        return out
    return out.unionByName(met.filter("stays").dropDuplicates(["_key"]).select("row.*"))
