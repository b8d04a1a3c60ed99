"""Sets of hashed word shingles of whole texts, made for batches of texts by array operations.

A word is a run without separators, its letters A to Z lower-cased; its hash is a polynomial over its bytes, from
prefix sums over the batch. A shingle's hash mixes those of its words. Sets hold 64-bit hashes; two different
shingles of a corpus of n share one with a chance of about n * n / 2**65.
"""

from __future__ import annotations

import numpy as np

from quern.llm.common import ASCII_LOWER

WORDS = 5
#: Multipliers of the hashes, all odd.
BASE = 0x9E3779B97F4A7C15
_MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)
_PLACES = (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)
_SEPARATOR = np.zeros(256, bool)
_SEPARATOR[[32, *range(9, 14)]] = True
BYTE_VALUES = np.random.default_rng(5).integers(0, 1 << 64, 256, np.uint64)
_powers: list[np.ndarray] = []
#: Bytes that are hashed at a time, give or take a word.
_CHUNK = 1 << 19


def power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2**64."""
    if len(_powers) < 2 or len(_powers[0]) < n:
        size = max(n, 1 << 16)
        inverse = pow(BASE, -1, 1 << 64)
        for k, x in enumerate((BASE, inverse)):
            steps = np.full(size, x, np.uint64)
            steps[0] = 1
            _powers[k:] = [np.cumprod(steps, dtype=np.uint64)]
    return _powers[0], _powers[1]


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads all bits of 64-bit numbers; one to one."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(_MIX[0])
    h = (h ^ (h >> np.uint64(27))) * np.uint64(_MIX[1])
    return h ^ (h >> np.uint64(31))


def word_places(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all words in order, where they end in the texts joined by single bytes, where each text's words begin among them, and each text in the joined ones (one more entry each)."""
    joined = np.frombuffer(b" ".join([*texts, b""]).translate(ASCII_LOWER), np.uint8)
    begins = np.cumsum([0, *(len(t) + 1 for t in texts)])
    apart = _SEPARATOR[joined]
    hashes, starts, ends, at = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0
    while at < len(joined):
        end = at + _CHUNK
        end = len(joined) if end >= len(joined) else end + int(apart[end:].argmax())  # a separator ends each chunk
        own, first, last = _chunk_hashes(joined[at:end], apart[at:end])
        hashes.append(own)
        starts.append(first + at)
        ends.append(last + at)
        at = end
    return np.concatenate(hashes), np.concatenate(ends), np.searchsorted(np.concatenate(starts), begins), begins


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and where each text's words begin in them (one more entry: their number)."""
    hashes, _, at, _ = word_places(texts)
    return hashes, at


def _chunk_hashes(b: np.ndarray, apart: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, starts and ends of the words of a run of bytes that neither begins nor ends within a word."""
    edge = np.diff(np.concatenate([[True], apart, [True]]).astype(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    powers, inverses = power_tables(len(b) + 1)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[b] * powers[: len(b)], dtype=np.uint64)])
    h = (sums[ends] - sums[starts]) * inverses[starts]
    return mix(h + (ends - starts).astype(np.uint64) * np.uint64(BASE)), starts, ends


def shingle_sets(texts: list[bytes], words: int = WORDS) -> list[np.ndarray]:
    """Each text's distinct shingle hashes in ascending order; with fewer words than that, the whole sequence as one; without words none."""
    h, at = word_hashes(texts)
    n = np.diff(at)
    out: list[np.ndarray] = []
    if len(h) >= words:
        last = len(h) - words + 1
        rolled = h[:last] * np.uint64(_PLACES[0])
        for i in range(1, words):
            rolled += h[i : last + i] * np.uint64(_PLACES[i % 5] + 2 * (i // 5))
        rolled = mix(rolled)
    for start, k in zip(at[:-1].tolist(), n.tolist(), strict=True):
        if k >= words:
            out.append(np.unique(rolled[start : start + k - words + 1]))
        elif k:
            short = np.uint64(k)
            for i in range(k):
                short = (short + h[start + i : start + i + 1]) * np.uint64(_PLACES[i % 5])
            out.append(mix(short))
        else:
            out.append(np.zeros(0, np.uint64))
    return out
