"""Pieces of batches are bounded in bytes, too, and what a worker no longer needs is given back after each batch."""

import pyarrow as pa

from pagelattice.llm import _common


def batch(texts):
    return pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts)], ["id", "text"])


def test_pieces_of_long_texts_are_bounded_in_bytes():
    texts = ["x" * 100_000] * 500 + ["y" * 6_000_000] + [None, ""] + ["short"] * 1000
    got = list(_common.pieces([batch(texts)]))
    assert [t for p in got for t in p.column(1).to_pylist()] == texts
    assert [i for p in got for i in p.column(0).to_pylist()] == list(range(len(texts)))
    assert all(p.num_rows == 1 or (p.nbytes <= 4 << 20 and p.num_rows <= 512) for p in got)
    assert max(p.num_rows for p in got) == 512


def test_memory_is_given_back_after_each_batch(monkeypatch):
    calls = []
    monkeypatch.setattr(_common, "released", lambda: calls.append(1))
    assert [p.num_rows for p in _common.pieces([batch(["a"] * 3), batch(["b"] * 2)], 2)] == [2, 1, 2] and len(calls) == 2
    monkeypatch.undo()
    _common.released()
