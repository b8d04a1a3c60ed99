"""Exact top-k by inner product over a pivot-distance index.

Vectors get one more component that makes their lengths equal; the largest inner products are then the smallest
distances. A vector's key is its nearest pivot and its distance from it; keys of one pivot in one ring of distances
are an annulus, packed into blocks of bounded size. For a query, annuli are sorted by their gap: the least distance
that the triangle inequality allows from the query to anything in them. The search goes in rounds over that order.
Each round takes more annuli, and stops for a query where the gap passes its k-th best distance so far. Queries are
packed and sent to the blocks that they still need; a task holds one block and streams the queries past it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.common import Scratch, small_batches, stage

PIVOTS, RINGS, BLOCK_ROWS, SAMPLE_ROWS = 32, 16, 2048, 4096
QUERY_BATCH, ROUND_GROWTH = 256, 4
_SLACK = 1e-6
#: Sums of products below the first bound are exact as doubles, below the second as 64-bit integers.
_DOUBLE, _LONG = 2**53, 2**63
#: Stands for a null id inside tasks: after all other ids.
_NO_ID = np.iinfo(np.int64).max
_FOUND = "query_id long, vec_id long, score long"


def quantised(vectors: DataFrame, vector_col: str, id_col: str, scale: int = 256) -> DataFrame:
    """vec_id, v array<long>: floor(scale * x) of every component; rows with nulls or non-finite components are left out."""
    v = F.col(vector_col)
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    ok = v.isNotNull() & ~F.coalesce(bad, F.lit(False))
    ints: Column = F.transform(v.cast("array<double>"), lambda x: F.floor(x * scale))
    return vectors.filter(ok).select(F.col(id_col).cast("long").alias("vec_id"), ints.alias("v"))


def _matrix(column: pa.Array, dims: int, kind: type = np.float64) -> np.ndarray:
    """Vectors as rows, zeros behind shorter ones."""
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    sizes = np.diff(offsets)
    out = np.zeros((len(sizes), dims), kind)
    out[np.arange(dims)[None] < sizes[:, None]] = values[offsets[0] : offsets[-1]]
    return out


def _lifted(x: np.ndarray, longest2: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest2 - (x * x).sum(axis=1, keepdims=True), 0))], axis=1)


def _distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None] - 2 * (a @ b.T), 0))


def choose_pivots(sample: np.ndarray, pivots: int) -> np.ndarray:
    """Rows of the sample far from each other, the first one first."""
    chosen, far = [0], _distances(sample, sample[:1])[:, 0]
    while len(chosen) < min(pivots, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, _distances(sample, sample[chosen[-1:]])[:, 0])
    return sample[chosen]


def best_of_block(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of the k best of each row that reach its floor, without the query's own id; ties to the smaller id.

    A floor is the k-th best score found elsewhere: what lies below can't be among the best.
    """
    at = scores >= floor[:, None]
    at &= ids[None] != own[:, None]
    many = np.flatnonzero(at.sum(axis=1) > 4 * k)
    if len(many):
        lowest = np.iinfo(scores.dtype).min if scores.dtype == np.int64 else -np.inf
        held = np.where(at[many], scores[many], lowest)
        at[many] &= held >= np.partition(held, -k, axis=1)[:, -k][:, None]
    rows, cols = np.nonzero(at)
    order = np.lexsort((ids[cols], -scores[rows, cols], rows))
    rows, cols = rows[order], cols[order]
    first = np.searchsorted(rows, rows)
    keep = np.arange(len(rows)) - first < k
    return rows[keep], cols[keep]


def _packed(x: np.ndarray) -> bytes:
    return np.ascontiguousarray(x).tobytes()


def search(base: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score: the k rows of base (vec_id, v) with the largest inner products for each row of queries (vec_id, v).

    Rows with the query's own id are no candidates. Rows of base with a null id are, after all others of their score;
    queries with a null id are not asked. Fewer than k candidates give fewer rows; repeated rows of base count each,
    and of repeated queries each is answered once. Shorter vectors count as followed by zeros. Scores are exact: as
    doubles below 2**53, as 64-bit integers below 2**63; vectors whose scores could be larger are an error. The index
    is fitted on SAMPLE_ROWS rows; results don't depend on the fit. Only pivots and the rings' bounds come to the driver.
    """
    spark, scratch = base.sparkSession, Scratch(base.sparkSession)
    none = spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    norm2 = F.aggregate(F.transform("v", lambda x: x.cast("double") * x), F.lit(0.0), lambda a, x: a + x)
    largest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double")))))
    dims, longest2, most = base.agg(F.max(F.size("v")), F.max(norm2), largest).first()
    widest, highest = queries.filter("vec_id is not null").agg(F.max(F.size("v")), largest).first()
    if dims is None or widest is None:
        return none
    dims, longest2 = max(dims, widest), longest2 or 0.0
    size = dims * (most or 0.0) * (highest or 0.0)
    if size >= _LONG or max(most or 0.0, highest or 0.0) >= _LONG:
        raise ValueError("inner products of these vectors may not fit 64 bits")
    kind = np.float64 if size < _DOUBLE else np.int64
    sample = base.orderBy(F.xxhash64("vec_id", F.lit(10)), "vec_id").limit(SAMPLE_ROWS).select("v").toArrow().column("v").combine_chunks()
    pivots = choose_pivots(_lifted(_matrix(sample, dims), longest2), PIVOTS)
    reach = 2 * np.sqrt(longest2) + 1
    width = reach / RINGS / 2

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                d = _distances(_lifted(_matrix(b.column(1), dims), longest2), pivots)
                near = d.argmin(axis=1)
                dist = d[np.arange(len(d)), near]
                cells = [pa.array(near.astype(np.int32)), pa.array(dist), pa.array((dist / width).astype(np.int32))]
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *cells], names=["vec_id", "v", "pivot", "dist", "ring"])

    small_batches(spark, 4096)
    keyed = scratch.stage(base.select("vec_id", "v").mapInArrow(key, "vec_id long, v array<long>, pivot int, dist double, ring int"), "topk-keys")
    annuli = keyed.groupBy("pivot", "ring").agg(F.count(F.lit(1)).alias("n"), F.min("dist").alias("low"), F.max("dist").alias("high")).collect()  # PIVOTS * (2 * RINGS + 1) rows at most
    annuli.sort(key=lambda r: (r["pivot"], r["ring"]))
    low, high = (np.array([r[c] for r in annuli]) for c in ("low", "high"))
    of, sizes = np.array([r["pivot"] for r in annuli]), np.array([-(-r["n"] // BLOCK_ROWS) for r in annuli])
    cuts = F.create_map(*[F.lit(x) for i, r in enumerate(annuli) for x in (r["pivot"] * 100_000 + r["ring"], i)])
    annulus = cuts[F.col("pivot") * 100_000 + F.col("ring")].alias("annulus")
    parts = F.array(*[F.lit(int(x)) for x in sizes])
    block = F.pmod(F.xxhash64("vec_id", F.monotonically_increasing_id()), parts[F.col("annulus")]).cast("int").alias("block")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by annulus and block as packed blocks; a run that goes on in the next batch gives another one."""
        for b in batches:
            a, s, ids = b.column(0).to_numpy(), b.column(1).to_numpy(), pa.compute.fill_null(b.column(2), _NO_ID).to_numpy()
            edges = [0, *(np.flatnonzero((a[1:] != a[:-1]) | (s[1:] != s[:-1])) + 1).tolist(), len(a)]
            x = _matrix(b.column(3), dims, kind)
            runs = [(i, j) for i, j in zip(edges[:-1], edges[1:], strict=True) if j > i]
            cells = [pa.array([a[i] for i, _ in runs], pa.int32()), pa.array([s[i] for i, _ in runs], pa.int32()), pa.array([_packed(ids[i:j]) for i, j in runs], pa.binary()), pa.array([_packed(x[i:j]) for i, j in runs], pa.binary())]
            yield pa.RecordBatch.from_arrays(cells, names=["annulus", "block", "ids", "m"])

    dealt = keyed.select("vec_id", "v", annulus).select("annulus", block, "vec_id", "v").repartition("annulus", "block").sortWithinPartitions("annulus", "block")
    index = scratch.stage(dealt.mapInArrow(pack, "annulus int, block int, ids binary, m binary"), "topk-blocks")
    asked = scratch.stage(queries.filter("vec_id is not null").select("vec_id", "v").dropDuplicates(["vec_id"]), "topk-queries")

    def gaps(batches: Iterator[pa.RecordBatch]):
        """For each batch of queries: ids, vectors, floors, annuli by gap, and how many of them lie within the k-th best distance."""
        for b in batches:
            for at in range(0, b.num_rows, QUERY_BATCH):
                own = b.slice(at, QUERY_BATCH)
                x = _matrix(own.column(1), dims)
                norms = (x * x).sum(axis=1)
                to_pivot = _distances(np.concatenate([x, np.zeros((len(x), 1))], axis=1), pivots)
                gap = np.maximum(0, np.maximum(low - to_pivot[:, of], to_pivot[:, of] - high))
                order = np.argsort(gap + 1e-9 * to_pivot[:, of], axis=1, kind="stable")
                known = own.column(2).is_valid().to_numpy(zero_copy_only=False)
                floor = pa.compute.fill_null(own.column(2), np.iinfo(np.int64).min).to_numpy()
                bound = np.where(known, np.sqrt(np.maximum(norms + longest2 - 2.0 * np.where(known, floor, 0), 0)), np.inf)
                within = np.take_along_axis(gap, order, 1) <= (bound * (1 + _SLACK) + _SLACK * reach)[:, None]
                yield own.column(0).to_numpy(), own.column(1), floor, order, within

    def routes(start: int, stop: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for ids, vectors, floor, order, within in gaps(batches):
                x = _matrix(vectors, dims, kind)
                who, turn = np.nonzero(within[:, start:stop])
                to = order[who, turn + start]
                by = np.argsort(to, kind="stable")
                who, to = who[by], to[by]
                edges = [0, *(np.flatnonzero(to[1:] != to[:-1]) + 1).tolist(), len(to)]
                for i, j in zip(edges[:-1], edges[1:], strict=True):
                    if j > i:
                        a, w = int(to[i]), who[i:j]
                        row, n = (_packed(ids[w]), _packed(x[w]), _packed(floor[w])), int(sizes[a])
                        cells = [pa.array([a] * n, pa.int32()), pa.array(range(n), pa.int32()), *(pa.array([v] * n, pa.binary()) for v in row)]
                        yield pa.RecordBatch.from_arrays(cells, names=["annulus", "block", "ids", "m", "floor"])

        return run

    def product(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows sorted by block, its vectors first: only those are held while its queries stream by."""
        now, held = None, []
        for b in batches:
            for a, s, ids, m, floor in zip(*[b.column(i).to_pylist() for i in range(5)], strict=True):
                if (a, s) != now:
                    now, held = (a, s), []
                ids, x = np.frombuffer(ids, np.int64), np.frombuffer(m, kind).reshape(-1, dims)
                if floor is None:
                    held.append((ids, x))
                    continue
                for vec_ids, y in held:
                    scores = x @ y.T
                    r, c = best_of_block(scores, vec_ids, ids, np.frombuffer(floor, np.int64), k)
                    if len(r):
                        out = vec_ids[c]
                        yield pa.RecordBatch.from_arrays([pa.array(ids[r]), pa.array(out, mask=out == _NO_ID), pa.array(scores[r, c].astype(np.int64))], names=["query_id", "vec_id", "score"])

    def ranked(found: DataFrame) -> DataFrame:
        """The k best of each query; ranks are cut before the shuffle, so a query sends k rows a task."""
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), F.asc_nulls_last("vec_id")))
        return found.withColumn("rank", rank).filter(F.col("rank") <= k)

    def bounded(best: DataFrame | None) -> DataFrame:
        floors = best.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("floor")) if best else None
        return asked.join(floors, "vec_id", "left") if best else asked.withColumn("floor", F.lit(None).cast("long"))

    def waiting(start: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield pa.RecordBatch.from_arrays([pa.array([sum(int(within[:, start].sum()) for *_, within in gaps(batches))], pa.int64())], names=["n"])

        return run

    best, start, stop = None, 0, 1
    small_batches(spark, 1024)
    while start < len(annuli) and (best is None or bounded(best).mapInArrow(waiting(start), "n long").agg(F.sum("n")).first()[0]):
        routed = bounded(best).mapInArrow(routes(start, stop), "annulus int, block int, ids binary, m binary, floor binary")
        both = index.withColumn("floor", F.lit(None).cast("binary")).unionByName(routed)
        met = both.repartition("annulus", "block").sortWithinPartitions("annulus", "block", F.col("floor").isNotNull())
        found = met.mapInArrow(product, _FOUND)
        best = scratch.stage(ranked(found if best is None else best.drop("rank").unionByName(found)), "topk-best")
        start, stop = stop, min(len(annuli), stop * (1 + ROUND_GROWTH))
    out = stage(best.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"), "topk-result")
    scratch.drop()
    return out


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """search() of the rows whose id is divisible by every against all rows, components quantised."""
    scratch = Scratch(vectors.sparkSession)
    ints = scratch.stage(quantised(vectors, vector_col, id_col), "topk-vectors")
    out = search(ints, ints.filter(F.pmod("vec_id", F.lit(every)) == 0), k)
    scratch.drop()
    return out
