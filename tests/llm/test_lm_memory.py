"""Workers outlive jobs: tasks that don't score give back the mixer of an earlier one first."""

import random
import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from quern.llm import lm_score


class Frame:
    """Stands for a DataFrame and returns a task's function instead of running it."""

    def select(self, *_):
        return self

    def groupBy(self, *_):
        return self

    def mapInArrow(self, f, _):
        return f


def test_other_tasks_drop_the_mixer(monkeypatch):
    monkeypatch.setattr(lm_score, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    texts = pa.RecordBatch.from_arrays([pa.array([0], pa.int32()), pa.array([b"a b"]), pa.array([False])], names=["block", "body", "held_out"])
    for task, batch in ((lm_score.count_contexts(Frame()), texts.select([1])), (lm_score.anchor_rows(Frame()), texts)):
        lm_score._mixers[0] = object()
        list(task(iter([batch])))
        assert not lm_score._mixers


def test_arrays_stay_small():
    """The mixer takes little more than four bytes a counter; anchors of many texts don't need arrays of all their words."""
    mixer = lm_score.Mixer(np.zeros(lm_score._STARTS[-1], np.int8), 0.01)
    assert sum(x.nbytes for paths in mixer._paths for x in (paths if isinstance(paths, tuple) else [paths])) < 4.5 * lm_score._STARTS[-1]
    rng = random.Random(4)
    texts = [b"", *(" ".join(f"w{rng.randrange(10**5)}" for _ in range(rng.randrange(3000))).encode() for _ in range(500)), b"", b"w"]
    want = [(i, p, k) for i, t in enumerate(texts) for _, p, k in zip(*(x.tolist() for x in lm_score.anchors([t])), strict=True)]
    tracemalloc.start()
    got = lm_score.anchors(texts)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert list(zip(*(x.tolist() for x in got), strict=True)) == want and len(want) > 1000
    assert most < 32 << 20
    assert [len(x) for x in lm_score.anchors([])] == [0, 0, 0]
