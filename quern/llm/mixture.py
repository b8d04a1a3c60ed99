"""Mixing sources to target weights by a low-discrepancy schedule; DataFrame functions only.

Every source is a stream of words: its documents in shuffled order, twice over. The stream is cut into blocks of
equally many words. Slot i of the schedule is the point frac(i * golden ratio) of the unit interval, which the sources
divide by their targets; the k-th slot of a source takes the k-th block of its stream. The mix is in the order of slots.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import WORD_WITH_GAP, Scratch, stage, word_count

#: Weights of the sources in order of their names, repeated; share of all words that is taken; most times that a source's words are used.
WEIGHTS, SHARE, EPOCHS = (5, 2, 1), 1.5, 2
BLOCK_WORDS = 2048
GOLDEN = (math.sqrt(5) - 1) / 2
_GRID, _CHUNK, _COPIES = 4096, 16384, 4096


def source_targets(sized: DataFrame) -> DataFrame:
    """sized: source, size. One row per source: source, source_idx, n_docs, source_size, target (double), words (rounded target).

    Targets share SHARE of all words by weight; one that passes EPOCHS times its source's size stops there, and the
    excess goes to the others by weight. One row per source passes through a single task.
    """
    by_name, by_room = Window.orderBy(F.col("source").asc_nulls_last()), Window.orderBy("room", "source_idx")
    up_to, onward = by_room.rowsBetween(Window.unboundedPreceding, -1), by_room.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    per = sized.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("n_docs"))
    per = per.withColumn("source_idx", F.row_number().over(by_name) - 1).withColumn("weight", weights[F.col("source_idx") % len(WEIGHTS)])
    per = per.withColumn("cap", (F.col("source_size") * EPOCHS).cast("double")).withColumn("room", F.col("cap") / F.col("weight"))
    level = (SHARE * F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(up_to), F.lit(0.0))) / F.sum("weight").over(onward)
    per = per.withColumn("level", level).withColumn("level", F.max("level").over(everything))
    per = per.withColumn("target", F.least("cap", F.col("weight") * F.col("level")))
    return per.select("source", "source_idx", "n_docs", "source_size", "target", F.round("target").cast("long").alias("words"))


def schedule(targets: DataFrame, scratch: Scratch, block_words: int = BLOCK_WORDS) -> DataFrame:
    """slot, source_idx, rank: for every source the ranks 0 to ceil(words / block_words) - 1, each in one slot.

    A source whose interval got a slot too few takes the missing ones after all others.
    """
    spark = targets.sparkSession
    total = targets.agg(F.coalesce(F.sum("words"), F.lit(0))).first()[0]
    n = -(-total // block_words)
    everything, before = Window.partitionBy(), Window.orderBy("source_idx").rowsBetween(Window.unboundedPreceding, -1)
    need = F.ceil(F.col("words") / block_words).cast("long")
    cuts = targets.filter("words > 0").withColumn("low", F.coalesce(F.sum("words").over(before), F.lit(0))).withColumn("all", F.sum("words").over(everything))
    cuts = cuts.select("source_idx", need.alias("need"), (F.col("low") / F.col("all")).alias("low"), ((F.col("low") + F.col("words")) / F.col("all")).alias("high"))
    cells = cuts.withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * _GRID), F.least(F.floor(F.col("high") * _GRID), F.lit(_GRID - 1)))))
    point = F.col("id") * F.lit(GOLDEN) + F.lit(0.5)
    slots = spark.range(n).select(F.col("id").alias("slot"), (point - F.floor(point)).alias("point")).withColumn("cell", F.floor(F.col("point") * _GRID))
    owned = slots.join(cells, "cell").filter((F.col("point") >= F.col("low")) & (F.col("point") < F.col("high")))
    owned = scratch.stage(owned.select("slot", "source_idx", "need", F.expr(f"slot div {_CHUNK}").alias("chunk")), "mix-slots")
    counts = owned.groupBy("source_idx", "chunk").agg(F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("source_idx").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.withColumn("offset", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    ranked = owned.withColumn("in_chunk", F.row_number().over(Window.partitionBy("source_idx", "chunk").orderBy("slot")) - 1)
    ranked = ranked.join(offsets, ["source_idx", "chunk"]).withColumn("rank", F.col("offset") + F.col("in_chunk")).filter("rank < need").select("slot", "source_idx", "rank")
    got = cuts.join(counts.groupBy("source_idx").agg(F.sum("n").alias("got")), "source_idx", "left").withColumn("got", F.coalesce("got", F.lit(0))).filter("got < need")
    late = got.withColumn("rank", F.explode(F.sequence("got", F.col("need") - 1)))
    late = late.select((F.lit(n) + (F.col("rank") - F.col("got")) * _CHUNK + F.col("source_idx")).alias("slot"), "source_idx", "rank")
    return ranked.unionByName(late)


def _key(id_col: Column) -> Column:
    return F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary"))


def positions(groups: DataFrame, targets: DataFrame, n_docs: int) -> DataFrame:
    """groups (doc_id, source, _size, _n: how many documents are alike in these, and what else they carry) as a row per document.

    Added are source_idx, source_size, target, words and pos: the words of its source's shuffled stream before it.
    A source of any size is split by the first digits of the shuffle key; only sums per part are added up in order.
    Documents alike stand side by side, are counted before they are ordered, and numbered after.
    """
    digits = max(2, math.ceil(math.log(max(n_docs, 1) / 5000 + 1, 16)))
    rows = groups.join(targets.drop("n_docs").withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    rows = rows.withColumn("_key", _key(F.col("doc_id"))).withColumn("_part", F.substring("_key", 1, digits)).withColumn("_all", F.col("_size") * F.col("_n"))
    earlier = Window.partitionBy("source_idx").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy("source_idx", "_part").agg(F.sum("_all").alias("_words")).withColumn("_offset", F.coalesce(F.sum("_words").over(earlier), F.lit(0))).drop("_words")
    ties = [c for c in ("_mark",) if c in groups.columns]
    within = Window.partitionBy("source_idx", "_part").orderBy("_key", "doc_id", "_size", *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("_in", F.coalesce(F.sum("_all").over(within), F.lit(0)))
    rows = rows.join(sums, ["source_idx", "_part"]).withColumn("pos", F.col("_offset") + F.col("_in")).drop("_key", "_part", "_offset", "_in", "_all")
    runs = rows.withColumn("_run", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(_n - 1) div {_COPIES}"))))  # arrays of bounded length
    each = runs.withColumn("_copy", F.explode(F.sequence(F.col("_run") * _COPIES, F.least(F.col("_n"), (F.col("_run") + 1) * _COPIES) - 1)))
    return each.withColumn("pos", F.col("pos") + F.col("_copy") * F.col("_size")).drop("_run", "_copy", "_n")


def pieces(placed: DataFrame, slots: DataFrame, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mix: slot, source_idx, pos, epoch, word_start, n_words, one row for each run of a document's words in a slot."""
    start = F.col("epoch") * F.col("source_size") + F.col("pos")
    runs = placed.filter("_size > 0").select("source_idx", "source_size", "words", "pos", "_size", F.explode(F.array(*[F.lit(e).cast("long") for e in range(EPOCHS)])).alias("epoch"))
    runs = runs.withColumn("a", start).withColumn("b", F.least(F.col("a") + F.col("_size"), "words")).filter("b > a")
    runs = runs.withColumn("rank", F.explode(F.sequence(F.expr(f"a div {block_words}"), F.expr(f"(b - 1) div {block_words}"))))
    low, high = F.greatest("a", F.col("rank") * block_words), F.least("b", (F.col("rank") + 1) * block_words)
    runs = runs.select("source_idx", "rank", "pos", "epoch", (low - F.col("a")).alias("word_start"), (high - low).alias("n_words"))
    return runs.join(slots, ["source_idx", "rank"]).select("slot", "source_idx", "pos", "epoch", "word_start", "n_words")


def _mark(id_col: Column, source: Column, text: Column) -> Column:
    """Alike for rows with one id, source and text."""
    return F.md5(F.concat(F.md5(F.coalesce(text, F.lit("")).cast("binary")), F.coalesce(id_col.cast("string"), F.lit("null")), F.coalesce(F.concat(F.lit("/"), source), F.lit(""))).cast("binary"))


def mix_plan(docs: DataFrame, scratch: Scratch, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS, marked: bool = False) -> tuple[DataFrame, DataFrame]:
    """(placed, pieces): documents with their place in the streams, and the mix as runs of words in slots.

    Null texts and texts without words have size 0 and are never taken; a null source is a source of its own, last in
    order. Rows that repeat an id are documents of their own. Without any words all targets are 0.
    """
    marks = [_mark(F.col(id_col), F.col("source"), F.col(text_col)).alias("_mark")] if marked else []
    sized = scratch.stage(docs.select(F.col(id_col).alias("doc_id"), F.col("source"), word_count(F.col(text_col)).alias("_size"), *marks), "mix-sizes")
    targets = scratch.stage(source_targets(sized.withColumnRenamed("_size", "size")).coalesce(1), "mix-targets")
    n_docs = targets.agg(F.coalesce(F.sum("n_docs"), F.lit(0))).first()[0]
    groups = sized.groupBy(*sized.columns).agg(F.count(F.lit(1)).alias("_n"))
    placed = scratch.stage(positions(groups, targets, n_docs), "mix-placed")
    return placed, pieces(placed, schedule(targets, scratch, block_words), block_words)


def mix_taken(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, first_slot (where its words come first in the mix; null if none is taken)."""
    scratch = Scratch(docs.sparkSession)
    placed, runs = mix_plan(docs, scratch, id_col, text_col, block_words)
    taken = runs.groupBy("source_idx", "pos").agg(F.sum("n_words").alias("taken"), F.min("slot").alias("first_slot"))
    rows = placed.withColumn("_at", F.when(F.col("_size") > 0, F.col("pos")))
    joined = rows.join(taken.withColumnsRenamed({"pos": "_at"}), ["source_idx", "_at"], "left")
    out = joined.select(F.col("doc_id").alias(id_col), F.col("_size").alias("size"), "source_size", "target", F.coalesce("taken", F.lit(0)).alias("taken"), "first_slot")
    out = stage(out, "mix-result")
    scratch.drop()
    return out


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """The mixed documents with the columns of docs, in the order of the schedule: a row per document and epoch, its text cut to the words that are taken.

    The words of a document that one epoch takes are always its first ones, as a target ends within one document at
    most. Rows that repeat id, source and text count as copies of one of them, whose other columns they get.
    """
    scratch = Scratch(docs.sparkSession)
    placed, runs = mix_plan(docs, scratch, id_col, text_col, block_words, marked=True)
    taken = runs.groupBy("source_idx", "pos", "epoch").agg(F.sum("n_words").alias("_taken"), F.min("slot").alias("_slot"))
    plan = stage(placed.filter("_size > 0").join(taken, ["source_idx", "pos"]).select("_mark", "_size", "_taken", "_slot", "epoch"), "mix-plan")
    rows = docs.select(_mark(F.col(id_col), F.col("source"), F.col(text_col)).alias("_mark"), F.struct("*").alias("_row"))  # other columns can't clash
    if not placed.groupBy("_mark").count().filter("count > 1").isEmpty():
        rows = rows.dropDuplicates(["_mark"])
    mixed = rows.join(plan, "_mark").orderBy("_slot", "epoch", "_mark")
    scratch.drop()
    whole = F.col("_row")[text_col]
    first = F.array_join(F.slice(F.regexp_extract_all(whole, F.lit(WORD_WITH_GAP), F.lit(0)), 1, F.col("_taken").cast("int")), "")
    mixed = mixed.withColumn("_text", F.when(F.col("_taken") >= F.col("_size"), whole).otherwise(first))
    new = {text_col: F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return mixed.select(*[new.get(c, F.col("_row")[c]).alias(c) for c in docs.columns])
