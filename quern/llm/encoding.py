"""Encoding with files of the tokenizers library, with a bounded cache of the pieces between single separators.

Both vocabularies split a text at a single space or line feed between two other characters before anything else, so
the ids of a text are those of its pieces in order. A text where white space stands otherwise, or which may hold the
string of an added token, is encoded as a whole.
Pieces are found, hashed and looked up by array operations; only unseen ones become strings. The cache knows a piece
by a 64-bit hash of its bytes, length and separator: two of a million pieces share one with a chance of about 3e-8.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa

from quern.llm.shingles import BASE, BYTE_VALUES, mix, power_tables

#: log2 of the cache's places, of which half are used at most; then the cache starts anew. About 45 bytes a piece.
CACHE_BITS = 21
_TOGETHER, _CHUNK = 32, 1 << 19
_BARE, _AFTER_SPACE, _AFTER_LINE = 0, 1, 2
_ODD = -1
_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this worker for a vocabulary file; loaded once per process."""
    if path not in _encoders:
        _encoders.clear()
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


class PieceEncoder:
    def __init__(self, path: str, cache_bits: int = CACHE_BITS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        #: How added tokens begin; the library looks for them before anything else, so a text that may hold one is encoded as a whole.
        self._openings = sorted({t.content[:2] for t in self._tokenizer.get_added_tokens_decoder().values()})
        self._bits = cache_bits
        #: What parts pieces that are encoded together, and its only id: a line feed, or a control where white space has no id.
        self._mark = "\n" if self._run(["\n"])[0] else " \x01 "
        (self._mark_id,) = np.frombuffer(self._run([self._mark])[0], "<u4")
        self._line = self._run(["\n"])[0]
        self._stops = {x: self._run([x])[0] for x in ",."}
        self._forget()

    def _forget(self) -> None:
        self._hash = np.zeros(1 << self._bits, np.uint64)
        self._ref = np.zeros(1 << self._bits, np.int32)
        self._n, self._start, self._length = 0, np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self._used, self._ids = 0, np.zeros(1 << 18, "<u4")

    def encode(self, texts: pa.Array | list[str]) -> list[np.ndarray]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        if not len(texts):
            return []
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        held = texts.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
        out: list[np.ndarray] = []
        at = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(offsets, offsets[at] + _CHUNK, "right")) - 1)
            end = min(end, len(texts))
            ids, whole = self._group(data[offsets[at] : offsets[end]], offsets[at : end + 1] - offsets[at])
            if len(whole):
                for i, own in zip(whole.tolist(), self._run(texts.take(pa.array(whole + at)).to_pylist()), strict=True):
                    ids[i] = np.frombuffer(own, "<u4")
            out += ids
            at = end
        return out

    def _group(self, data: np.ndarray, offsets: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """The ids of the texts that lie between the offsets, and which of them must be encoded as a whole."""
        n = len(offsets) - 1
        cuts = np.flatnonzero((data == 32) | (data == 10)) + 1
        starts = np.concatenate([cuts, offsets[:-1]])
        opens = np.concatenate([np.zeros(len(cuts), bool), np.ones(n, bool)])  # whether a text begins here
        order = np.argsort(starts * 2 + opens, kind="stable")
        starts, opens = starts[order], opens[order]
        last = np.concatenate([opens[1:], [True]])
        ends = np.concatenate([starts[1:], [0]]) - 1
        ends[last] = offsets[1:]
        lead = np.where(opens, _BARE, np.where(data[np.maximum(starts - 1, 0)] == 32, _AFTER_SPACE, _AFTER_LINE) if len(data) else _BARE)
        powers, inverses = power_tables(len(data) + 1)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(BYTE_VALUES[data] * powers[: len(data)], dtype=np.uint64)])

        def hashed(a: np.ndarray, b: np.ndarray, kind: np.ndarray) -> np.ndarray:
            h = (sums[b] - sums[a]) * inverses[a] + (b - a).astype(np.uint64) * np.uint64(BASE)
            return np.maximum(mix(h + kind.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), np.uint64(1))

        hashes = hashed(starts, ends, lead)
        place = self._find(hashes)
        new = np.flatnonzero(place < 0)
        if len(new):
            _, first = np.unique(hashes[new], return_index=True)
            fresh = new[first]
            if self._n + 2 * len(fresh) > 1 << (self._bits - 1):
                self._forget()
                _, fresh = np.unique(hashes, return_index=True)
            heads = hashed(starts[fresh], np.maximum(ends[fresh] - 1, starts[fresh]), lead[fresh])
            self._learn(data, starts[fresh], ends[fresh], lead[fresh], hashes[fresh], heads)
            place = self._find(hashes)
        ref = self._ref[place]
        sizes = self._length[ref].astype(np.int64)
        odd = sizes == _ODD
        sizes[odd] = 0
        total = np.concatenate([[0], np.cumsum(sizes)])
        joined = self._ids[np.repeat(self._start[ref] - total[:-1], sizes) + np.arange(total[-1])]
        begins = np.flatnonzero(opens)
        bounds = total[np.append(begins, len(starts))].tolist()
        whole = np.flatnonzero(np.logical_or.reduceat(odd, begins)) if odd.any() else np.zeros(0, np.int64)
        return [joined[i:j] for i, j in zip(bounds[:-1], bounds[1:], strict=True)], whole

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash in the table, or -1."""
        mask = np.int64((1 << self._bits) - 1)
        at = (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        there = self._hash[at]
        out = np.where(there == hashes, at, -1)
        todo = np.flatnonzero((there != hashes) & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + 1) & mask
            there = self._hash[at[todo]]
            hit = there == hashes[todo]
            out[todo[hit]] = at[todo[hit]]
            todo = todo[~hit & (there != 0)]
        return out

    def _put(self, hashes: np.ndarray, values: list[bytes | None]) -> None:
        """Adds distinct unknown hashes with their ids; None marks an odd piece."""
        k = len(values)
        joined = np.frombuffer(b"".join(v for v in values if v), "<u4")
        while self._n + k > len(self._start):
            self._start, self._length = (np.concatenate([x, np.zeros_like(x)]) for x in (self._start, self._length))
        while self._used + len(joined) > len(self._ids):
            self._ids = np.concatenate([self._ids, np.zeros_like(self._ids)])
        lengths = np.fromiter((_ODD if v is None else len(v) // 4 for v in values), np.int32, k)
        real = np.maximum(lengths, 0)
        self._ids[self._used : self._used + len(joined)] = joined
        self._start[self._n : self._n + k] = self._used + np.cumsum(real) - real
        self._length[self._n : self._n + k] = lengths
        mask, at = np.int64((1 << self._bits) - 1), (hashes >> np.uint64(64 - self._bits)).astype(np.int64)
        refs, todo = np.arange(self._n, self._n + k, dtype=np.int32), np.arange(k)
        while len(todo):
            free = todo[self._hash[at[todo]] == 0]
            _, one = np.unique(at[free], return_index=True)
            won = free[one]
            self._hash[at[won]], self._ref[at[won]] = hashes[won], refs[won]
            todo = todo[self._hash[at[todo]] != hashes[todo]]
            at[todo] = (at[todo] + 1) & mask
        self._n, self._used = self._n + k, self._used + len(joined)

    def _run(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self._tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def _run_pieces(self, pieces: list[str], lead: str) -> list[bytes]:
        glue, out = self._mark + lead, []
        parts = [pieces[i : i + _TOGETHER] for i in range(0, len(pieces), _TOGETHER)]
        for part, ids in zip(parts, self._run([lead + glue.join(x) for x in parts]), strict=True):
            ends = np.flatnonzero(np.frombuffer(ids, "<u4") == self._mark_id) * 4
            if len(ends) != len(part) - 1:
                raise ValueError("the vocabulary doesn't keep pieces apart")
            at = 0
            for end in [*ends.tolist(), len(ids)]:
                out.append(ids[at:end])
                at = end + 4
        return out

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lead: np.ndarray, hashes: np.ndarray, heads: np.ndarray) -> None:
        """Encodes unseen pieces and puts them into the cache. A comma or full stop after a letter is a token of its own, so the rest is looked up first."""
        raw, values, todo, stopped = data.tobytes(), [b""] * len(starts), ([], []), []
        known = self._find(heads)
        for i, (a, b, k) in enumerate(zip(starts.tolist(), ends.tolist(), lead.tolist(), strict=True)):
            x = raw[a:b].decode()
            if x.isalpha():
                todo[k == _AFTER_SPACE].append((x, i))
            elif x[:-1].isalpha() and x[-1] in ",.":
                stopped.append((x, i))
            elif not x:
                values[i] = b"" if k == _BARE else None
            elif x != x.strip() or "\x01" in x or "᠎" in x or "\x85" in x or any(o in x for o in self._openings):
                values[i] = None
            else:
                todo[k == _AFTER_SPACE].append((x, i))
        extra: dict[int, tuple[str, int]] = {}  # heads that are neither known nor among the pieces
        own = set(hashes.tolist()) if stopped else set()
        for x, i in stopped:
            h = int(heads[i])
            if known[i] < 0 and h not in own and h not in extra:
                extra[h] = (x[:-1], int(lead[i]))
        extra_values: dict[int, bytes] = {}
        for spaced in (0, 1):
            more = [(x, h) for h, (x, k) in extra.items() if (k == _AFTER_SPACE) == bool(spaced)]
            got = self._run_pieces([x for x, _ in (*todo[spaced], *more)], " " if spaced else "")
            for (_, i), v in zip(todo[spaced], got, strict=False):
                values[i] = v if lead[i] != _AFTER_LINE else self._line + v
            for (_, h), v in zip(more, got[len(todo[spaced]) :], strict=True):
                extra_values[h] = v if extra[h][1] != _AFTER_LINE else self._line + v
        at = {int(h): i for i, h in enumerate(hashes.tolist())} if stopped else {}
        for x, i in stopped:
            h = int(heads[i])
            if known[i] >= 0:
                r = self._ref[known[i]]
                head = self._ids[self._start[r] : self._start[r] + self._length[r]].tobytes()
            else:
                head = extra_values[h] if h in extra_values else values[at[h]]
            values[i] = head + self._stops[x[-1]]
        self._put(np.concatenate([hashes, np.array(list(extra_values), np.uint64)]), [*values, *extra_values.values()])


def crc(ids: np.ndarray) -> int:
    """Unsigned crc32 of ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
