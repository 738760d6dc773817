"""What tasks of the pipeline hold at a time: a few times a small block of text, and nothing of stages before."""

import sys
import tracemalloc
import types

import numpy as np
import pyarrow as pa
import pytest

from cairn.llm import common, near_join, neighbours, suffix_dedup


def batch():
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(5000)])
    texts = [" ".join(words[rng.integers(0, 5000, 350)]) for _ in range(2000)]
    rows = pa.array(range(len(texts)))
    return pa.RecordBatch.from_arrays([rows, rows, pa.array(texts)], ["row_id", "doc_id", "text"])


def voted(batches):
    weights = np.random.default_rng(1).random((3000, neighbours.TERMS), np.float32)
    voters = neighbours.Voters(weights, np.arange(3000) % 2)
    del weights
    tracemalloc.reset_peak()
    for one in batches:
        yield from neighbours.block_scores(voters, one.column("text"))


@pytest.mark.parametrize("task", [suffix_dedup.seed_counts, suffix_dedup.mark_rows, near_join.set_rows, voted])
def test_a_task_holds_little(task):
    rows = batch()
    tracemalloc.start()
    try:
        for _ in task(iter([rows])):
            pass
        assert tracemalloc.get_traced_memory()[1] < 64 << 20
    finally:
        tracemalloc.stop()


def test_tokenizers_of_earlier_stages_go():
    held = types.ModuleType("cairn_worker_encoders")
    sys.modules["cairn_worker_encoders"] = held
    assert list(common.released(iter([1]), encoders=True)) == [1] and sys.modules["cairn_worker_encoders"] is held
    assert list(common.released(iter([1, 2]))) == [1, 2] and "cairn_worker_encoders" not in sys.modules
