"""LM scoring by online logistic context mixing.

A text's bytes are coded bit by bit, high bits first. Each of several contexts (the last bytes, or the last bytes of
the word) is hashed to a slot, and each slot has a predictor for all 255 nodes of a byte's binary
tree: the log odds of the counts that this node had over all training documents. A mixer adds the predictors' log
odds with weights chosen by two gates, the bit's place in the byte and whether the last byte belongs to a word. A
last stage refines the sum by a bent line of its own for every bit's place. Weights and bends start alike for every text
and learn while it is read: after each segment they step along the gradient of its cost, and the next segment is
coded with the new ones. Every bit is thus predicted from what comes before it alone, and the probabilities of all
texts add up to at most one. A text ends with a flag that is coded before every byte.

A further predictor has long contexts, in a table that grows with the training rows. Of all places after four words,
those whose words hash to one in ANCHOR_ONE_IN of the values are anchors. An anchor's words that occur there at least twice in
training documents predict the bytes that follow them most often, as long as they come true and up to the next
anchor. The table is summed up by shuffles; a block of documents gets only the anchors that its texts have.

The baseline is a unigram model over words with one added to every count. Documents are dealt by id into blocks of
bounded size; a block's distinct words meet their counts, and only those come back to the block.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.llm import counters
from quern.llm.common import Scratch, give_back, small_batches, stage
from quern.llm.shingles import mix, word_places

#: Contexts, the first weights of their predictors, and the bits of the number of their slots.
CONTEXTS, FIRST_WEIGHTS, SLOT_BITS = ("2 bytes", "3 bytes", "4 bytes", "5 bytes of the word"), (0.2, 0.3, 0.35, 0.2), (12, 14, 16, 15)
#: Rates of the weights and of the last stage, what is added to the counts of a bit, and the kinks of the last stage.
RATE, REFINE_RATE, ADDED, KINKS = 0.2, 0.1, 0.3, (1.0, 3.0)
SEGMENTS, LONGEST_SEGMENT = (64, 64, 128), 256
BLOCK_BYTES, LEAST_BLOCKS = 16 << 20, 64
_PAD, _SCALE = 5, 16.0
#: Anchors: words of the context, one place in so many (a power of two), bytes that follow, the predictor's first weight.
ANCHOR_WORDS, ANCHOR_ONE_IN, FOLLOWING, ANCHOR_WEIGHT = 4, 64, 128, 2.0
#: Counters of all contexts one after the other, cut into parts of so many.
_STARTS = np.cumsum([0, *(1 << (b + 8) for b in SLOT_BITS)]).tolist()
_PART = 1 << 16
_LANE_BYTES, _GROUP_BYTES, _LANES, _BUILD, _CHUNK, _RUN = 1 << 16, 1 << 21, 32, 1 << 11, 1 << 18, 1 << 19
#: Multipliers of the hashes of contexts.
_HASH = (0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F)
_WORD_HASH = (0x165667B1, 0xD3A2646D, 0xFD7046C5, 0xB55A4F09, 0x2545F491)
_IN_WORD = np.ones(256, np.uint32)
_IN_WORD[[*range(33), *b".,;:!?|()\"'"]] = 0
_WORD_MASK = (_IN_WORD * 255).astype(np.uint8)
#: For byte c and bit k (high first): the tree's node before the bit, and the bit as -1 or 1.
_NODE = np.array([[(1 << k) | (c >> (8 - k)) for k in range(8)] for c in range(256)])
_SIGN = np.array([[2 * ((c >> (7 - k)) & 1) - 1 for k in range(8)] for c in range(256)], np.int8)
#: For the exclusive or of a byte and the one foretold: 1 for bits foretold right, -1 for the first wrong one, 0 after it.
_AGREE = np.array([[1 if c >> (7 - k) == 0 else -1 if c >> (8 - k) == 0 else 0 for k in range(8)] for c in range(256)], np.int8)
_AGREE_HALVES = [np.ascontiguousarray(_AGREE[:, i : i + 4]).view(np.uint32)[:, 0] for i in (0, 4)]
#: Odd multipliers of the words of an anchor.
_PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)


def context_keys(padded: np.ndarray) -> list[np.ndarray]:
    """For each context, slot * 256 + byte at every place of padded (uint8) from _PAD on; texts in it follow _PAD zeros."""
    n = len(padded) - _PAD
    wide, alive = padded.astype(np.uint32), _WORD_MASK[padded]
    byte, joined = wide[_PAD:], wide[_PAD - 1 : _PAD - 1 + n]
    out = []
    for k in range(1, 4):
        joined = joined | (wide[_PAD - 1 - k : _PAD - 1 - k + n] << np.uint32(8 * k))
        out.append(joined * np.uint32(_HASH[k - 1]))
    word, in_word = np.zeros(n, np.uint32), np.uint8(255)
    for k, m in enumerate(_WORD_HASH, 1):
        own = slice(_PAD - k, _PAD - k + n)
        in_word = in_word & alive[own]
        term = (padded[own] & in_word).astype(np.uint32)
        term *= np.uint32(m)
        word += term
    word ^= word >> np.uint32(15)
    word *= np.uint32(_HASH[3])
    for h, b in zip((*out, word), SLOT_BITS, strict=True):
        h >>= np.uint32(32 - b)
        h <<= np.uint32(8)
        h |= byte
    return [*out, word]


def count_contexts(train: DataFrame) -> DataFrame:
    """Counters of (context, slot, byte) over all bytes of column body, as rows of counters."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(_STARTS[-1], np.uint32)
        for b in batches:
            texts = [x for x in b.column(0).to_pylist() if x]
            if not texts:
                continue
            gap = bytes(_PAD)
            padded = np.frombuffer(gap + gap.join(texts), np.uint8)
            between = ((np.cumsum([len(t) + _PAD for t in texts])[:-1] - _PAD)[:, None] + np.arange(_PAD)).reshape(-1)
            for i in range(0, len(padded) - _PAD, _CHUNK):
                own = between[slice(*np.searchsorted(between, (i, i + _CHUNK)))] - i
                for start, keys in zip(_STARTS, context_keys(padded[i : i + _CHUNK + _PAD]), strict=False):
                    np.add.at(total[start:], keys.astype(np.intp), np.uint32(1))
                    np.subtract.at(total[start:], keys[own], np.uint32(1))  # what lies between texts doesn't count
        yield from counters.emit(total, len(total) // _PART, TaskContext.get().partitionId())
        give_back()

    return train.select("body").mapInArrow(count, counters.SCHEMA)


def log_odds(counts: np.ndarray) -> np.ndarray:
    """Counts by (slot, byte) to the log odds of every node of the slots' trees, in steps of 1 / _SCALE, as int8."""
    level = counts.reshape(-1, 256).astype(np.float64)
    nodes = np.zeros((len(level), 256))
    for k in range(7, -1, -1):
        nodes[:, 1 << k : 2 << k] = np.log((level[:, 1::2] + ADDED) / (level[:, 0::2] + ADDED))
        level = level[:, 0::2] + level[:, 1::2]
    return np.clip(np.rint(nodes * _SCALE), -127, 127).astype(np.int8)


def anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place in it, key) of all anchors, in order. Texts are looked at by runs of _RUN bytes, as arrays of all words of a block are large."""
    run = np.cumsum([0, *map(len, texts)]) // _RUN
    cuts = [0, *(np.flatnonzero(np.diff(run[:-1])) + 1).tolist(), len(texts)]
    parts = [(i, *_anchors(texts[i:j])) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return np.concatenate([of + i for i, of, _, _ in parts]), *(np.concatenate([p[k] for p in parts]) for k in (2, 3))


def _anchors(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    h, ends, at, begins = word_places(texts)
    last = max(0, len(h) - ANCHOR_WORDS + 1)
    key = np.zeros(last, np.uint64)
    for i, m in enumerate(_PLACES):
        key += h[i : last + i] * np.uint64(m)
    key = mix(key)
    of = np.repeat(np.arange(len(texts)), np.diff(at))
    found = np.flatnonzero((key < np.uint64((1 << 64) // ANCHOR_ONE_IN)) & (of[:last] == of[ANCHOR_WORDS - 1 :]))
    return of[found], ends[found + ANCHOR_WORDS - 1] - begins[of[found]], key[found].view(np.int64)


def anchor_rows(blocked: DataFrame) -> DataFrame:
    """block, key, following (null for held-out texts) of every anchor; fewer bytes follow at the end of a text."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for b in batches:
            texts = b.column(1).to_pylist()
            of, place, key = anchors(texts)
            held, block = b.column(2).to_numpy(zero_copy_only=False), b.column(0).to_numpy()
            follow = [None if held[i] else texts[i][p : p + FOLLOWING] for i, p in zip(of.tolist(), place.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(block[of]), pa.array(key), pa.array(follow, pa.binary())], names=["block", "key", "following"])
        give_back()

    return blocked.select("block", "body", "held_out").mapInArrow(find, "block int, key long, following binary")


def known_anchors(rows: DataFrame) -> DataFrame:
    """block, key, following, times, of: for each block its anchors that training texts have at least twice, what follows them most often, and how often of all times."""
    each = rows.filter("following is not null").groupBy("key", "following").agg(F.count(F.lit(1)).alias("n"))
    best = each.groupBy("key").agg(F.sum("n").alias("of"), F.max(F.struct("n", "following")).alias("b")).filter("of > 1")
    asked = rows.select("block", "key").distinct()
    return asked.join(best, "key").select("block", "key", F.col("b.following").alias("following"), F.col("b.n").alias("times"), "of")


class Hints:
    """A block's known anchors."""

    def __init__(self, keys: np.ndarray, following: list[bytes], times: np.ndarray, of: np.ndarray):
        order = np.argsort(keys)
        self._keys = keys[order]
        self._following = np.zeros((len(keys), FOLLOWING), np.uint8)
        for row, i in zip(self._following, order.tolist(), strict=True):
            row[: len(following[i])] = np.frombuffer(following[i], np.uint8)
        odds = np.log((times[order] + ADDED) / (of[order] - times[order] + ADDED))
        self._strength = np.clip(np.rint(odds * _SCALE), 0, 127).astype(np.int8)

    def of(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, the places of its known anchors and their numbers."""
        if not len(self._keys):
            return [(np.zeros(0, int), np.zeros(0, int))] * len(texts)
        text, place, key = anchors(texts)
        number = np.minimum(np.searchsorted(self._keys, key), len(self._keys) - 1)
        hit = self._keys[number] == key
        text, place, number = text[hit], place[hit], number[hit]
        cuts = np.searchsorted(text, np.arange(len(texts) + 1)).tolist()
        return [(place[i:j], number[i:j]) for i, j in zip(cuts[:-1], cuts[1:], strict=True)]

    def foretold(self, padded: np.ndarray, row: np.ndarray, place: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes foretold and their strengths (0: none), for padded (n, _PAD + bytes) with anchors at (row, place). A byte is foretold only if all since its anchor came true."""
        flat, width = np.append(padded.reshape(-1), np.zeros(FOLLOWING, np.uint8)), padded.shape[1]
        at = (row * width + place + _PAD)[:, None] + np.arange(FOLLOWING)
        told = self._following[number]
        true = flat[at] == told
        alive = np.ones_like(true)
        np.logical_and.accumulate(true[:, :-1], axis=1, out=alive[:, 1:])
        alive &= (place[:, None] + np.arange(FOLLOWING)) < width - _PAD
        byte, strength = np.zeros(len(flat), np.uint8), np.zeros(len(flat), np.int8)
        byte[at[alive]] = told[alive]
        strength[at[alive]] = np.broadcast_to(self._strength[number][:, None], alive.shape)[alive]
        n = padded.size
        return byte[:n].reshape(padded.shape)[:, _PAD:], strength[:n].reshape(padded.shape)[:, _PAD:]


class Mixer:
    """Scores texts by the predictors' tables: int8 log odds by node, all slots of all contexts in order."""

    def __init__(self, tables: np.ndarray, end_chance: float):
        nodes = [tables.reshape(-1)[i:j].reshape(-1, 256) for i, j in zip(_STARTS[:-1], _STARTS[1:], strict=True)]
        # for a slot and half a byte, the signed log odds of its four bits; those of the low half follow the whole byte
        self._paths = [(np.empty(t.size >> 4, np.uint32), np.empty(t.size, np.uint32)) for t in nodes]
        for paths, t in zip(self._paths, nodes, strict=True):
            for out, node, sign in zip(paths, (_NODE[::16, :4], _NODE[:, 4:]), (_SIGN[::16, :4], _SIGN[:, 4:]), strict=True):
                for i in range(0, len(t), _BUILD):
                    out[len(node) * i : len(node) * (i + _BUILD)] = (t[i : i + _BUILD, node] * sign).reshape(-1, 4).view(np.uint32).reshape(-1)
        self._go, self._end = math.log10(1 - end_chance), math.log10(end_chance)

    def score(self, texts: list[bytes], hints: Hints | None = None) -> np.ndarray:
        """log10 probability of each text."""
        told = hints.of(texts) if hints else None
        sizes = np.array([len(t) for t in texts], np.int64)
        out = sizes * self._go + self._end
        marked = np.array([len(p) > 0 for p, _ in told] if told else np.zeros(len(texts), bool))
        order = np.lexsort((sizes, marked))  # texts with anchors go together: for others, the predictor has nothing to say
        order = order[sizes[order] > 0]
        at = 0
        while at < len(order):
            lanes, one = 1, marked[order[at]]
            while at + lanes < len(order) and lanes < _LANES and (lanes + 1) * sizes[order[at + lanes]] <= _GROUP_BYTES and marked[order[at + lanes]] == one:
                lanes += 1
            own = order[at : at + lanes]
            marks = [told[i] for i in own] if told else []
            out[own] -= self._cost([texts[i] for i in own], sizes[own], hints if one else None, marks) / math.log(10)
            at += lanes
        return out

    def _inputs(self, padded: np.ndarray, unit: int, more: int) -> tuple[np.ndarray, np.ndarray]:
        """For the bytes of each row from _PAD on, cut into runs of unit: the signed log odds as (run, context, half byte, text, byte), four bits in each, with room for more contexts, and the word gate."""
        n, size = padded.shape[0], padded.shape[1] - _PAD
        flat = np.concatenate([padded.reshape(-1), np.zeros(_PAD, np.uint8)])
        signed = np.empty((size // unit, len(self._paths) + more, 2, n, unit), np.uint32)
        for i, ((high, low), keys) in enumerate(zip(self._paths, context_keys(flat), strict=True)):
            at = keys.reshape(n, size + _PAD)[:, :size].reshape(n, -1, unit).swapaxes(0, 1).astype(np.intp)
            signed[:, i, 1] = low.take(at)
            signed[:, i, 0] = high.take(np.right_shift(at, 4, out=at))
        return signed, _IN_WORD[padded[:, _PAD - 1 : _PAD - 1 + size]].astype(np.float32)

    def _cost(self, texts: list[bytes], sizes: np.ndarray, hints: Hints | None = None, marks: list[tuple[np.ndarray, np.ndarray]] = ()) -> np.ndarray:
        """Natural-log cost of each text's bytes; the texts, the shortest first, go side by side, through a window over their bytes. Arrays are (bit, text, byte)."""
        n, most = len(texts), int(sizes[-1])
        unit = min((e for e in np.cumsum(SEGMENTS).tolist() if e >= most), default=LONGEST_SEGMENT)
        padded = np.zeros((n, -(-most // unit) * unit + _PAD), np.uint8)
        for row, t in zip(padded, texts, strict=True):
            row[_PAD : _PAD + len(t)] = np.frombuffer(t, np.uint8)
        k = len(self._paths) + (hints is not None)
        weights = np.zeros((8, n, 2, k), np.float32)  # of a byte that follows no word, and what is added if it follows one
        weights[:, :, 0] = (*FIRST_WEIGHTS, ANCHOR_WEIGHT)[:k]
        if hints:
            row = np.repeat(np.arange(n), [len(p) for p, _ in marks])
            byte, strength = hints.foretold(padded, row, *(np.concatenate(x) for x in zip(*marks, strict=True)))
        weights /= np.float32(_SCALE)
        refine = np.zeros((8, n, 1, 1 + len(KINKS)), np.float32)
        refine[..., 0] = 1
        inputs = np.empty(0, np.float32)
        cost, start, turn, end, over = np.zeros(n), 0, 0, 0, 0
        while start < most:
            if start == end:  # a new window; no segment crosses its end
                first, here = start, over
                end = min(padded.shape[1] - _PAD, start + max(1, _LANE_BYTES // (n - over) // unit) * unit)
                signed, gate = self._inputs(padded[over:, start : end + _PAD], unit, int(hints is not None))
                if hints:
                    other = (padded[over:, start + _PAD : end + _PAD] ^ byte[over:, start:end]).reshape(n - over, -1, unit).swapaxes(0, 1)
                    for i, agree in enumerate(_AGREE_HALVES):
                        signed[:, -1, i] = agree[other]
            stop = start + (SEGMENTS[turn] if turn < len(SEGMENTS) else LONGEST_SEGMENT)  # all whole, so that sums run alike whatever texts lie side by side
            size, lanes, (run, at) = stop - start, n - over, divmod(start - first, unit)
            inside = np.ascontiguousarray(gate[over - here :, start - first : stop - first])
            if inputs.shape != (k, 8, lanes, size):
                # contexts, gates and bends come first, so that a step on all bits of all texts runs over one stretch of memory
                inputs, both, bends = (np.empty((i, 8, lanes, size), np.float32) for i in (k, 2, 1 + len(KINKS)))
                by_context, by_gate, by_bend = (x.transpose(1, 2, 0, 3) for x in (inputs, both, bends))
                bits, sums = np.empty((k, 2, lanes, size), np.int32), np.empty((8, lanes, 1, size), np.float32)
            four = signed[run, :, :, over - here :, at : at + size]
            for i in range(4):
                np.left_shift(four, np.uint32(24 - 8 * i), out=bits.view(np.uint32))
                np.right_shift(bits, np.int32(24), out=bits)  # with its sign
                inputs.reshape(k, 2, 4, lanes, size)[:, :, i] = bits
            if hints:
                inputs[-1] *= strength[over:, start:stop].astype(np.float32)
            np.matmul(weights[:, over:], by_context, out=by_gate)
            np.multiply(both[1], inside, out=bends[0])
            bends[0] += both[0]
            for x, kink in zip(bends[1:], KINKS, strict=True):
                np.clip(bends[0], -kink, kink, out=x)
            y, wrong = np.matmul(refine[:, over:], by_bend, out=sums)[:, :, 0], both[0]
            np.exp(np.clip(y, -30, 30, out=y), out=y)
            np.divide(1, np.add(y, 1, out=wrong), out=wrong)  # the chance of the other bit
            y *= wrong
            y[:4] *= y[4:]  # one logarithm for two bits; each chance is above exp(-31), so their product doesn't vanish in a float32
            np.log(y[:4, :, : most - start], out=y[:4, :, : most - start])
            y[:4, :, most - start :] = 0
            logs, ending = y[:4], int(np.searchsorted(sizes, stop, "right"))
            logs[:, : ending - over] *= np.arange(start, stop) < sizes[over:ending, None]
            cost[over:] -= logs.sum(axis=2).sum(axis=0)
            if stop >= most:
                break
            np.multiply(wrong, inside, out=both[1])
            own = np.s_[:, ending - over :]  # texts that end here learn no more
            weights[:, ending:] += np.float32(RATE / _SCALE**2 / size) * (by_gate[own] @ by_context[own].swapaxes(2, 3))
            refine[:, ending:, 0, 1:] += np.float32(REFINE_RATE / size) * np.moveaxis(np.vecdot(bends[1:, own[0], own[1]], wrong[own]), 0, 2)
            start, turn, over = stop, turn + 1, ending
        return cost


def block_of(id_col: Column, body: Column, blocks: int) -> Column:
    """By id and text, so that rows which repeat one of them are dealt over blocks."""
    return F.pmod(F.xxhash64(id_col, body, F.lit(1)), F.lit(blocks)).cast("int")


def words_of(texts: pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of texts (binary) in order, and where each text's words begin in them (one more entry: their number)."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pa.concat_arrays(texts.chunks).view(pa.string())))  # at a space and the controls 9 to 13, whatever the other bytes
    words = lists.flatten().view(pa.binary())
    real = pc.greater(pc.binary_length(words), 0)
    return words.filter(real), np.cumsum(np.append(0, real.to_numpy(zero_copy_only=False)))[lists.offsets.to_numpy()]


def word_counts(blocked: DataFrame) -> DataFrame:
    """block, word, n (in the block's training documents), c (in all): one row for each block's distinct word.

    A word has a row for each block of BLOCK_BYTES at most, so none has a share of all rows that would hold up a task.
    """

    def count(t: pa.Table) -> pa.Table:
        forget()
        words, at = words_of(t.column("body"))
        held = t.column("held_out").to_numpy()
        known = words.dictionary_encode()
        n = np.bincount(known.indices.to_numpy()[~np.repeat(held, np.diff(at))], minlength=len(known.dictionary))
        words = pa.concat_arrays([known.dictionary, pa.array([b""])])  # and the end of a text
        n = np.append(n, np.count_nonzero(~held))
        give_back()
        return pa.table({"block": pa.array(np.full(len(n), t.column("block")[0].as_py()), pa.int32()), "word": words, "n": pa.array(n, pa.int64())})

    pairs = blocked.groupBy("block").applyInArrow(count, "block int, word binary, n long")
    over = Window.partitionBy("word")
    return pairs.withColumn("c", F.sum("n").over(over)).withColumn("first", F.min("block").over(over) == F.col("block"))


def score_documents(docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id, held_out, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte of every row.

    Both models learn from all rows that aren't held out. Null texts are empty: one token, the end. Without training
    rows every count is 0. bits_per_byte is null for empty texts. Rows that repeat an id are scored each, and alike
    for equal texts. No rows give no rows.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    small_batches(spark)
    body = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("body"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    train = body.filter(~F.col("held_out"))
    sizes = body.agg(F.sum(F.octet_length("body")), F.sum(F.when(~F.col("held_out"), F.octet_length("body"))), F.count(F.when(~F.col("held_out"), 1))).first()
    every, learnt, texts = (x or 0 for x in sizes)
    blocks = max(LEAST_BLOCKS, -(-every // BLOCK_BYTES))
    blocked = body.withColumn("block", block_of(F.col("id"), F.col("body"), blocks))
    words = scratch.stage(word_counts(blocked), "lm-words")
    n, v = words.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.when(F.col("first") & (F.col("c") > 0), 1))).first()
    tables = counters.collected(count_contexts(train), log_odds, _STARTS[-1] // _PART, _PART, np.int8)
    shared = spark.sparkContext.broadcast(zstandard.compress(tables.tobytes(), 3))  # a byte for each counter at most, 30 MB
    known = known_anchors(scratch.stage(anchor_rows(blocked), "lm-anchors"))
    chance = (texts + 1) / (learnt + texts + 2)
    of_none = math.log10(1 / (n + v + 1))

    def score(left: pa.Table, right: pa.Table) -> pa.Table:
        is_word = pc.equal(right.column("of"), 0)
        marks, right = right.filter(pc.invert(is_word)), right.filter(is_word)
        hints = Hints(marks.column("c").to_numpy(), marks.column("word").to_pylist(), marks.column("times").to_numpy(), marks.column("of").to_numpy())
        c = right.column("c").to_numpy()
        logs = np.where(c > 0, np.log10((c + 1) / (n + v + 1)), of_none)
        words, at = words_of(left.column("body"))
        value_set = pa.concat_arrays(right.column("word").chunks)
        own = pc.index_in(words, value_set=value_set).to_numpy()
        own = np.insert(own, at[1:], pc.index(value_set, b"").as_py())  # with its end, each text has a token at least
        at += np.arange(len(at))
        n_tokens, n_known, base = np.diff(at), *(np.add.reduceat(x[own], at[:-1]) for x in ((c > 0).astype(np.int64), logs))
        del words, own, value_set, right  # before the mixer's arrays
        bodies = left.column("body").to_pylist()
        scores = mixer(shared, chance).score(bodies, hints)
        give_back()
        bits = [-s / math.log10(2) / len(t) if t else None for s, t in zip(scores.tolist(), bodies, strict=True)]
        return pa.table({id_col: left.column("id"), "held_out": left.column("held_out"), "n_tokens": pa.array(n_tokens, pa.int64()), "n_known": pa.array(n_known, pa.int64()), "train_tokens": pa.array([n] * len(bodies), pa.int64()), "base_score": pa.array(base, pa.float64()), "score": pa.array(scores), "bits_per_byte": pa.array(bits, pa.float64())})

    schema = f"`{id_col}` long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double, bits_per_byte double"
    zero = F.lit(0).cast("long")
    asked = words.select("block", "word", "c", zero.alias("times"), zero.alias("of")).unionByName(known.select("block", F.col("following").alias("word"), F.col("key").alias("c"), "times", "of"))
    out = stage(blocked.groupBy("block").cogroup(asked.groupBy("block")).applyInArrow(score, schema), "lm-result")
    scratch.drop()
    return out


_mixers: dict[int, Mixer] = {}


def mixer(shared, chance: float) -> Mixer:
    """The mixer of this worker for a broadcast model; only the last one is kept."""
    key = zlib.crc32(shared.value)
    if key not in _mixers:
        _mixers.clear()
        _mixers[key] = Mixer(np.frombuffer(zstandard.decompress(shared.value), np.int8), chance)
    return _mixers[key]


def forget() -> None:
    """Drops the mixer (130 MB) that a worker still keeps from an earlier job, before tasks that don't score make arrays of their own."""
    _mixers.clear()
