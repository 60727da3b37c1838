import numpy as np
from pyspark.sql import functions as F

from pagelattice.llm import neighbours as N
from pagelattice.llm.neighbours import nearest_neighbours


def test_small_tables_and_rare_widths_miss_nothing(spark):
    """Default probes; 4 vectors of width 64, 6 of width 32 with copies, one alone in its width."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=64).tolist()) for i in range(4)] + [(i, rng.normal(size=32).tolist()) for i in range(10, 14)]
    rows += [(i, rows[4][1]) for i in range(14, 16)] + [(20, [1.0, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, F.lit(True)).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
        assert r.rank == len(got[r.query_id])
    unit = {i: np.array(v) / np.linalg.norm(v) for i, v in rows}
    want = {}
    for q, x in unit.items():
        others = [(-round(float(x @ y), 12), i) for i, y in unit.items() if i != q and len(y) == len(x)]
        want[q] = [i for _, i in sorted(others)[:5]]
    assert got == {q: v for q, v in want.items() if v}


def test_buckets_of_several_rotations(spark, monkeypatch):
    """Every bucket probed is exact search, in small blocks of members and queries."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(60, 8))
    both = N.axes(x, 0, 10**6, depth=2)
    assert both.shape == (60, 256) and all(sorted(row) == list(range(256)) for row in both.tolist())
    first, second = N.rotated(x, 0), N.rotated(x, 1)
    nearest = [2 * np.argmax(np.abs(y), 1) + (np.take_along_axis(y, np.argmax(np.abs(y), 1)[:, None], 1)[:, 0] < 0) for y in (first, second)]
    assert (both[:, 0] == nearest[0] * 16 + nearest[1]).all()
    monkeypatch.setattr(N, "BLOCK", 4)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 4 == 0, tables=1, probes=256, depth=2).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    scores = unit @ unit.T
    np.fill_diagonal(scores, -2)
    assert got == {q: np.argsort(-scores[q], kind="stable")[:5].tolist() for q in range(0, 60, 4)}
