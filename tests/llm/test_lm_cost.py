"""The mixer takes one logarithm for two bits, also where chances are as small as they get."""

import math

import numpy as np

from quern.llm import lm_score


def test_a_logarithm_for_two_bits(monkeypatch):
    mixer, taken, log = lm_score.Mixer(np.zeros(lm_score._STARTS[-1], np.int8), 0.01), [], np.log
    monkeypatch.setattr(lm_score.np, "log", lambda x, **more: (taken.append(x.size), log(x, **more))[1])
    score = mixer.score([b"a" * 1000])[0]
    assert sum(taken) == 4 * 1000
    assert math.isclose(score, 8000 * math.log10(0.5) + 1000 * math.log10(0.99) - 2, rel_tol=1e-5)


def test_least_chances_stay_finite(monkeypatch):
    """Each of the first 64 bytes' bits is foretold wrong at the bound, 30."""
    monkeypatch.setattr(lm_score, "FIRST_WEIGHTS", (99.0,) * 4)
    mixer = lm_score.Mixer(np.full(lm_score._STARTS[-1], 127, np.int8), 0.01)
    score = mixer.score([b"\0" * 64])[0]
    assert math.isclose(score, -64 * 8 * 30 / math.log(10) + 64 * math.log10(0.99) - 2, rel_tol=1e-4)
