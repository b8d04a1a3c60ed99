"""Packing token pieces into sequences: first-fit decreasing on a tournament tree, in randomised groups of documents.

Documents are encoded where they are read; only lengths and checksums of their pieces are shuffled. A piece of the
full sequence length is a sequence of its own. The others are dealt at random into groups of bounded size, and each
group is packed by first-fit decreasing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import Scratch, give_back, small_batches, stage
from quern.llm.encoding import crc, encoder

SEQUENCE = 4096
GROUP_PIECES = 8192
_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Tournament:
    """Capacities of bins as leaves; every inner node has the larger of its two children."""

    def __init__(self, bins: int, capacity: int):
        self._leaves = 1 << max(0, bins - 1).bit_length()
        self._best = [capacity] * (2 * self._leaves)

    def take(self, size: int) -> tuple[int, int]:
        """The first bin with room for size, and what it has left before; the room is taken."""
        best, at = self._best, 1
        while at < self._leaves:
            at *= 2
            if best[at] < size:
                at += 1
        before = best[at]
        best[at] -= size
        leaf, at = at - self._leaves, at // 2
        while at:
            best[at] = max(best[2 * at], best[2 * at + 1])
            at //= 2
        return leaf, before


def first_fit_decreasing(lengths: list[int], capacity: int = SEQUENCE) -> list[tuple[int, int]]:
    """(bin, offset in it) of each piece; of equal lengths the earlier goes first."""
    tree, out = Tournament(max(1, len(lengths)), capacity), [(0, 0)] * len(lengths)
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        leaf, before = tree.take(lengths[i])
        out[i] = (leaf, capacity - before)
    return out


def token_pieces(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens: every document's ids and its end id, cut every capacity ids."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end = np.array([end_id], "<u4")
        for b in batches:
            cols: list[list] = [[], [], [], [], []]
            for doc, ids in zip(b.column(0).to_pylist(), encoder(vocabulary).encode(b.column(1)), strict=True):
                ids = np.append(ids, end)
                for at in range(0, len(ids), capacity):
                    part = ids[at : at + capacity]
                    for col, v in zip(cols, (doc, at, len(part), crc(part), len(ids)), strict=True):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens"])
        give_back()

    small_batches(docs.sparkSession, 2048, "4m")
    return docs.select(F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))).mapInArrow(cut, _PIECES)


def pack(docs: DataFrame, vocabulary: str, end_id: int, capacity: int = SEQUENCE, group_pieces: int = GROUP_PIECES) -> DataFrame:
    """The pieces of docs, each with sequence_id and offset.

    Null and empty texts have the end id alone. Rows that repeat an id are documents of their own. A group has about
    group_pieces pieces, whatever the input's size. No rows give no rows; further columns are not looked at.
    """
    scratch = Scratch(docs.sparkSession)
    pieces = scratch.stage(token_pieces(docs, vocabulary, end_id, capacity), "pack-pieces")
    groups = max(1, -(-pieces.filter(F.col("length") < capacity).count() // group_pieces))
    group = F.pmod(F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id()), F.lit(groups))  # equal pieces are dealt over groups, too
    names = [f for f in pieces.columns]

    def fill(t: pa.Table) -> pa.Table:
        t = t.sort_by([(n, "ascending") for n in ("doc_id", "start", "ids_crc32", "doc_tokens")])
        placed = first_fit_decreasing(t.column("length").to_pylist(), capacity)
        first = t.column("grp")[0].as_py() << 32
        return pa.table({n: t.column(n) for n in names} | {"sequence_id": pa.array([first + s for s, _ in placed], pa.int64()), "offset": pa.array([o for _, o in placed], pa.int64())})

    packed = pieces.filter(F.col("length") < capacity).withColumn("grp", group).groupBy("grp").applyInArrow(fill, _PIECES + ", sequence_id long, offset long")
    full = pieces.filter(F.col("length") == capacity).withColumn("sequence_id", F.lit(1 << 62) + F.monotonically_increasing_id()).withColumn("offset", F.lit(0).cast("long"))
    out = stage(packed.unionByName(full), "pack-result")
    scratch.drop()
    return out
