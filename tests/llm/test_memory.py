"""What array code of a worker takes at its peak and keeps: workers live on beside the other stages of a pipeline."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from wordtide.llm import _bpe, _bytes, langid, minhash, packing

TEXTS = [f"wort{i % 977} and {i} more " * 100 for i in range(5_000)]  # about 10 MB
BATCH = pa.RecordBatch.from_arrays([pa.array(range(5_000)), pa.array(TEXTS), pa.array(range(5_000))], names=["doc_id", "text", "key"])


@pytest.fixture
def one_task(monkeypatch):
    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)  # noqa: N815

    monkeypatch.setattr(packing, "TaskContext", Task)


def _peak_mb(run, batch) -> float:
    tracemalloc.start()
    try:
        for _ in run(iter([batch])):
            pass
        return tracemalloc.get_traced_memory()[1] / 1e6
    finally:
        tracemalloc.stop()


def test_packing_takes_little_at_once(one_task, monkeypatch):
    monkeypatch.setattr(_bytes, "_POWERS", {})
    _bpe.load(packing.default_tokenizer())
    assert _peak_mb(packing._first_round(packing.default_tokenizer(), 2, 4096), BATCH) < 150
    assert sum(v.nbytes for v in _bytes._POWERS.values()) < 20e6


def test_signatures_take_little_at_once(monkeypatch):
    monkeypatch.setattr(_bytes, "_POWERS", {})
    assert _peak_mb(minhash._features(5, 160, 32), BATCH) < 20
    assert _peak_mb(minhash._sets(5), BATCH.select(["doc_id", "text"])) < 10


def test_language_id_takes_little_at_once():
    assert _peak_mb(langid._document_frequencies, BATCH.select(["text"])) < 27
    own = pa.Table.from_batches([BATCH.slice(0, 800)]).select(["doc_id", "text"]).append_column("lang", pa.array(["de"] * 800))
    tracemalloc.start()
    try:
        langid._fit_language(np.ones(langid.DIMS, np.float32), 4)(own)
        assert tracemalloc.get_traced_memory()[1] < 1.6 * 800 * langid.DIMS * 4  # the vectors once, and little besides
    finally:
        tracemalloc.stop()


def test_sums_of_rows_in_stretches():
    x = np.random.default_rng(3).random((60, 2_500), dtype=np.float32)
    rows = np.arange(60) % 3 == 1
    assert np.array_equal(langid._sum_of(x, rows), x[rows].sum(axis=0))
