"""Language identification by string kernels.

Texts are compared by the blended spectrum: for every length n of N_GRAMS the sets of byte n-grams present in two
texts, as the cosine of their indicator vectors, summed over n. Nyström landmarks, a few hundred texts, span the
kernel's feature map. Kernel ridge regression, one language against the rest, is fitted in it on all labelled texts:
tasks sum up the products of features, and only the sums come to the driver. As the kernel is linear in the normalised
indicators, landmarks and regression weights multiply into one matrix per n, and all texts are scored by products of
that matrix with batches of indicators.
"""

from __future__ import annotations

import math
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, replace
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import counters
from quern.llm.common import ASCII_LOWER, give_back, small_batches

N_GRAMS, BITS = (1, 2, 3, 4), 14
#: Landmarks (one a language if there are more languages), and the ridge.
LANDMARKS, RIDGE = 192, 0.1
#: More languages than this are an error: their weights (256 KB each) would not fit a worker.
MAX_LANGUAGES = 512
BATCH_TEXTS, FIT_TEXTS = 32, 64
#: Sums of a fit are integers, in steps of 1 / _STEPS, so that their order doesn't matter; they move in parts of _PART.
_STEPS, _PART = float(1 << 48), 1 << 14
#: Of the filter: shorter texts aren't told from noise; the share of held-back rows that may lie below the floor, and
#: of how many rows the floor's distance from the median is given away.
SHORT_BYTES, HELD_GRAMS, BELOW, UNSURE_ROWS = 256, 96, 0.001, 40
#: One text in so many is held back from the second fit; steps and reach of the histogram of held-back rows' values.
HELD_ONE_IN, BINS, REACH = 4, 4096, 8
UNDECIDED = "und"
#: Odd multipliers of the hashes of n-grams.
_MULTIPLIERS = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)


@dataclass(frozen=True)
class Model:
    languages: tuple[str, ...]
    weights: np.ndarray  # (len(N_GRAMS) * 2**BITS, languages), float32
    floor: float = -math.inf  # the best value that a text of a learned language has at least


def presence(texts: list[bytes]) -> np.ndarray:
    """Indicators (texts, len(N_GRAMS), 2**BITS) of the hashed n-grams of whole texts, ASCII letters lower-cased."""
    out = np.zeros((len(texts), len(N_GRAMS), 1 << BITS), np.uint8)
    for i, text in enumerate(texts):
        b = np.frombuffer(text.translate(ASCII_LOWER), np.uint8).astype(np.uint32)
        gram = np.zeros(len(b), np.uint32)
        for k, n in enumerate(N_GRAMS):
            if len(b) < n:
                break
            gram = b[n - 1 :] + (gram[: len(b) - n + 1] << np.uint32(8))
            out[i, k, (gram * np.uint32(_MULTIPLIERS[k])) >> np.uint32(32 - BITS)] = 1
    return out


def normalised(indicators: np.ndarray) -> np.ndarray:
    """Rows of length one for every n, side by side; zeros stay zeros."""
    x = indicators.astype(np.float32)
    x /= np.sqrt(np.maximum(x.sum(axis=2, keepdims=True), 1))
    return x.reshape(len(x), -1)


@dataclass(frozen=True)
class Landmarks:
    """The feature map that some texts' normalised indicators span: features(a) @ features(b) is nearly the kernel."""

    marks: np.ndarray
    root: np.ndarray

    def features(self, indicators: np.ndarray) -> np.ndarray:
        return (normalised(indicators) @ self.marks.T).astype(np.float64) @ self.root


def spanned(indicators: np.ndarray) -> Landmarks:
    marks = normalised(indicators)
    values, vectors = np.linalg.eigh((marks @ marks.T).astype(np.float64))
    keep = values > 1e-6 * values.max()
    return Landmarks(marks, vectors[:, keep] / np.sqrt(values[keep]))


def add_up(total: np.ndarray, features: np.ndarray, language: np.ndarray, shares: np.ndarray) -> None:
    """Adds rows, each with its language's share, to a sum (features, features + languages): products of features, and features by language."""
    rank = features.shape[1]
    weighed = features * shares[language][:, None]
    total[:, :rank] += weighed.T @ features
    for k in set(language.tolist()):
        total[:, rank + k] += weighed[language == k].sum(axis=0)


def solve(space: Landmarks, total: np.ndarray, languages: tuple[str, ...], ridge: float = RIDGE) -> Model:
    """Kernel ridge regression, one language against the rest, from the sum of rows whose shares add up to 1."""
    rank = total.shape[0]
    own = total[:, rank:]
    solved = np.linalg.solve(total[:, :rank] + ridge / 100 * np.eye(rank), 2 * own - own.sum(axis=1, keepdims=True))
    coefficients, step = space.root @ solved, 1 << BITS
    weights = [(space.marks[:, i : i + step].T.astype(np.float64) @ coefficients).astype(np.float32) for i in range(0, space.marks.shape[1], step)]
    return Model(languages, np.concatenate(weights))


def equal_shares(counts: np.ndarray) -> np.ndarray:
    """A row's share by language: every language that has rows weighs the same, all rows together 1."""
    return np.where(counts > 0, 1 / np.maximum(counts, 1) / max(1, np.count_nonzero(counts)), 0.0)


def round_robin(labels: list[str], most: int) -> list[int]:
    """Numbers of rows that go round the languages, in the order given: the first of each, the second of each, and so on."""
    seen: dict[str, int] = {}
    turn = [(seen.__setitem__(x, seen.get(x, 0) + 1), seen[x])[1] for x in labels]
    return sorted(range(len(labels)), key=lambda i: (turn[i], i))[: max(most, len(seen))]


def fit(indicators: np.ndarray, labels: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on rows in memory; the first rows of the languages are the landmarks."""
    languages = tuple(sorted(set(labels)))
    space, language = spanned(indicators[round_robin(labels, landmarks)]), np.array([languages.index(x) for x in labels])
    features = np.concatenate([space.features(indicators[i : i + FIT_TEXTS]) for i in range(0, len(labels), FIT_TEXTS)])
    total = np.zeros((features.shape[1], features.shape[1] + len(languages)))
    add_up(total, features, language, equal_shares(np.bincount(language, minlength=len(languages))))
    return solve(space, total, languages, ridge)


def scores(model: Model, texts: list[bytes]) -> np.ndarray:
    return np.concatenate([normalised(presence(texts[i : i + BATCH_TEXTS])) @ model.weights for i in range(0, len(texts), BATCH_TEXTS)])


def landmark_texts(rows: DataFrame) -> list[bytes]:
    """Packed indicators of LANDMARKS distinct texts (lang, text, held) of all languages in turn, by hash; those not held back come first."""
    keyed = rows.withColumn("h", F.xxhash64("text", "lang"))
    first = keyed.select("lang", "held", "h").distinct()
    for dealt in (["lang", F.pmod("h", F.lit(16))], ["lang"]):  # a common language's rows meet in parts before they meet as a whole
        order = Window.partitionBy(*dealt).orderBy("held", "h")
        first = first.withColumn("turn", F.row_number().over(order)).filter(F.col("turn") <= LANDMARKS)
    keys = sorted((r["turn"], r["lang"], r["h"]) for r in first.select("turn", "lang", "h").collect())  # LANDMARKS a language at most
    chosen = [keys[i][2] for i in round_robin([x for _, x, _ in keys], LANDMARKS)]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            bits = [np.packbits(presence([t])).tobytes() for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(bits, pa.binary())], names=["h", "bits"])

    texts = keyed.filter(F.col("h").isin(chosen)).groupBy("h").agg(F.min("text").cast("binary").alias("text"))
    bits = {r["h"]: bytes(r["bits"]) for r in texts.mapInArrow(pack, "h long, bits binary").collect()}
    return [bits[h] for h in chosen]


def _unpacked(bits: list[bytes]) -> np.ndarray:
    return np.unpackbits(np.frombuffer(b"".join(bits), np.uint8).reshape(len(bits), -1), axis=1).reshape(-1, len(N_GRAMS), 1 << BITS)


def summed_rows(rows: DataFrame, space: Landmarks, bits: list[bytes], languages: tuple[str, ...], shares: list[np.ndarray]) -> np.ndarray:
    """The sums of all rows (lang, text, held): one by the first shares, and by the second, if there are any, one of rows not held back."""
    rank, number = space.root.shape[1], {x: i for i, x in enumerate(languages)}
    shape = (len(shares), rank, rank + len(languages))
    parts = -(-math.prod(shape) // _PART)
    shared = rows.sparkSession.sparkContext.broadcast((bits, space.root))  # 8 KB a landmark

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, root = shared.value
        own, total = Landmarks(normalised(_unpacked(packed)), root), np.zeros(shape)
        for b in batches:
            for i in range(0, b.num_rows, FIT_TEXTS):
                lang, text, held = (b.column(k).slice(i, FIT_TEXTS) for k in range(3))
                features, language = own.features(presence(text.to_pylist())), np.array([number[x] for x in lang.to_pylist()])
                rest = ~np.array(held.to_pylist(), bool)
                add_up(total[0], features, language, shares[0])
                if len(shares) > 1:
                    add_up(total[1], features[rest], language[rest], shares[1])
        fixed = np.zeros(parts * _PART, np.int64)
        fixed[: total.size] = np.rint(total.reshape(-1) * _STEPS)
        yield from counters.emit(fixed.view(np.uint64), parts, TaskContext.get().partitionId())
        del own
        give_back()

    out = rows.select("lang", F.col("text").cast("binary"), "held").mapInArrow(add, counters.SCHEMA)
    whole = counters.collected(out, lambda x: x, parts, _PART, np.uint64).reshape(-1)[: math.prod(shape)]
    return whole.view(np.int64).reshape(shape) / _STEPS


def held_back_values(rows: DataFrame, model: Model) -> list[tuple[int, int]]:
    """The histogram, in steps of 1 / BINS, of the best values of all held-back rows (lang, text, held) that aren't short."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[int] = Counter()
        for b in batches:
            for i in range(0, b.num_rows, BATCH_TEXTS):
                x = presence(b.column(0).slice(i, BATCH_TEXTS).to_pylist())
                x = x[x[:, -1].sum(axis=1, dtype=np.int64) >= HELD_GRAMS]
                if len(x):
                    best = (normalised(x) @ shared.value.weights).max(axis=1)
                    seen.update(np.floor(np.clip(best, -REACH, REACH) * BINS).astype(int).tolist())
        yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int32()), pa.array(list(seen.values()), pa.int64())], names=["bin", "n"])
        give_back()

    counted = rows.filter("held").select(F.col("text").cast("binary")).mapInArrow(bins, "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n"))
    return sorted((r["bin"], r["n"]) for r in counted.collect())  # 2 * REACH * BINS + 1 rows at most


def held_back_floor(histogram: list[tuple[int, int]]) -> float:
    """The value that practically all held-back rows exceed; lower if they are few.

    It is 0.5 at most, half way from texts unlike all learned ones (near 0 or below, as there is no intercept) to alike ones.
    """
    upto = list(accumulate(n for _, n in histogram))
    if not upto:
        return -math.inf
    many = upto[-1]
    low, median = (histogram[bisect_right(upto, k)][0] / BINS for k in (int(many * BELOW), many // 2))
    return min(0.5, low - (median - low) * UNSURE_ROWS / many)


def train(labelled: DataFrame, floor: bool = False) -> Model | None:
    """Fits on all labelled (doc_id, text, lang), with the filter's floor if asked; None if nothing is labelled.

    Rows without text, letters or lang aren't labelled. More than MAX_LANGUAGES languages are an error; none is left out.
    Equal texts are held back together, so none of them is learned by the fit that the floor tries.
    """
    small_batches(labelled.sparkSession)
    lettered = F.col("lang").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike(r"\p{L}")
    held = F.pmod(F.xxhash64("text", F.lit(6)), F.lit(HELD_ONE_IN)) == 0
    rows = labelled.filter(lettered).select("lang", "text", held.alias("held"))
    counts = rows.groupBy("lang").agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("held")).alias("rest")).limit(MAX_LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages are labelled")
    counts.sort(key=lambda r: r["lang"])
    languages = tuple(r["lang"] for r in counts)
    every, rest = (np.array([r[k] for r in counts]) for k in ("n", "rest"))
    floor = floor and bool(0 < rest.sum() < every.sum())
    bits = landmark_texts(rows)
    space = spanned(_unpacked(bits))
    sums = summed_rows(rows, space, bits, languages, [equal_shares(every), equal_shares(rest)][: 1 + floor])
    model = solve(space, sums[0], languages)
    if floor:
        tried = solve(space, sums[1], languages)
        del space
        model = replace(model, floor=held_back_floor(held_back_values(rows, tried)))
    give_back()  # the driver goes on to other work
    return model


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, lang_pred and score (0 to 1) of every row.

    A null text, a text without letters, or any text if nothing was learned, gives UNDECIDED and 0. Ties go to the
    first language in order. Only the text is looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 4 * 2**14 numbers a language, of MAX_LANGUAGES languages at most

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            texts, lettered = b.column(1).to_pylist(), b.column(2).to_pylist()
            lang, best = [UNDECIDED] * len(texts), np.zeros(len(texts))
            at = [i for i, x in enumerate(lettered) if x] if known else []
            if at:
                raw = scores(known, [texts[i] for i in at]).astype(np.float64)
                chance = np.exp(3 * (raw - raw.max(axis=1, keepdims=True)))
                chance /= chance.sum(axis=1, keepdims=True)
                for i, k, p in zip(at, raw.argmax(axis=1), chance.max(axis=1), strict=True):
                    lang[i], best[i] = known.languages[k], p
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang), pa.array(best)], names=[id_col, "lang_pred", "score"])
        give_back()

    small_batches(docs.sparkSession)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col), F.col(text_col).cast("binary").alias("t"), lettered.alias("l")).mapInArrow(score, f"`{id_col}` {kind}, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, in which a language is found. Rows without letters or text go, and those of SHORT_BYTES or more below the model's floor."""
    fields = docs.schema
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for b in batches:
            lettered = np.array(b.column(b.num_columns - 1).to_pylist(), bool)
            texts = b.column(b.num_columns - 2)
            keep = np.zeros(len(lettered), bool)
            at = np.flatnonzero(lettered) if known else np.array([], int)
            if len(at):
                own = [texts[int(i)].as_py() for i in at]
                keep[at] = (scores(known, own).max(axis=1) > known.floor) | (np.array([len(t) for t in own]) < SHORT_BYTES)
            yield b.select(range(b.num_columns - 2)).filter(pa.array(keep))
        give_back()

    small_batches(docs.sparkSession)
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    free = "_" * (1 + max(len(c) for c in docs.columns))  # a name that no column has
    return docs.select("*", F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias(f"{free}bytes"), lettered.alias(f"{free}lettered")).mapInArrow(sift, fields)
