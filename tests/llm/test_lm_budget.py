"""Scoring spends nothing on texts that have ended, takes long texts side by side, and words come from array operations."""

import random

import numpy as np
import pyarrow as pa

from quern.llm import lm_score
from quern.llm.common import ASCII_LOWER


def mixer(seed=1):
    rng = np.random.default_rng(seed)
    return lm_score.Mixer(rng.integers(-60, 60, lm_score._STARTS[-1], np.int8), 0.01)


def logs_taken(monkeypatch, texts):
    m, taken, log = mixer(), [], np.log
    monkeypatch.setattr(lm_score.np, "log", lambda x, **more: (taken.append(x.size), log(x, **more))[1])
    m.score(texts)
    return taken


def test_ended_texts_cost_nothing(monkeypatch):
    taken = logs_taken(monkeypatch, [b"a b " * 75] * 31 + [b"abcd" * 1250])
    assert sum(taken) <= 4 * (32 * 512 + 5000)


def test_long_texts_go_side_by_side(monkeypatch):
    taken = logs_taken(monkeypatch, [b"abcd" * 5000] * 32)
    assert sum(taken) == 4 * 32 * 20000 and len(taken) <= 20000 // 256 + 4


def test_a_score_does_not_depend_on_the_texts_beside_it():
    rng = random.Random(2)
    texts = [bytes(rng.choice(b"abc de.") for _ in range(n)) for n in (1, 63, 64, 65, 128, 255, 256, 257, 511, 512, 513, 3000, 3000, 9001, 70000)]
    m = mixer()
    alone = [m.score([t])[0] for t in texts]
    assert (m.score([*texts, b""])[:-1] == alone).all() and np.isfinite(alone).all()


def test_words_of_many_texts():
    texts = [b"", b" ", b"  a", b"B  ", b"\x09\x0a\x0b\x0c\x0d", b"\x1c\x1d\x1e\x1f \x85\xc2\xa0", "Ä É z　z".encode(), b"A\x00B \xff\xfe cD\x0be", b"one two two"]
    words, at = lm_score.words_of(pa.chunked_array([pa.array(texts[:4], pa.binary()), pa.array(texts[4:], pa.binary())]))
    got = words.to_pylist()
    assert [got[i:j] for i, j in zip(at[:-1], at[1:], strict=True)] == [t.translate(ASCII_LOWER).split() for t in texts]
