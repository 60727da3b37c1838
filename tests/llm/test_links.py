import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagelattice.llm import links as L
from pagelattice.llm._common import Scratch, parity_sketch

U, A, H = range(100, 200), range(0, 100), range(1, 101)


def linked(spark, sets, percent, keys=None):
    """Components of sets that all share one key (or have their own), as {id: smallest reachable id}."""
    keyed = [(i, k, True) for i in sets for k in (keys[i] if keys else [7])]
    keyed = spark.createDataFrame(keyed, "id bigint, key bigint, chosen boolean")
    rows = [(i, len(s), bytearray(b"%d" % i), parity_sketch(np.array(list(s), np.uint64)).view(np.int64).tolist()) for i, s in sets.items()]
    meta = spark.createDataFrame(rows, "id bigint, n bigint, sig binary, sketch array<bigint>")
    items = spark.createDataFrame([(i, 0, list(s)) for i, s in sets.items()], "id bigint, part int, items array<bigint>")
    slices = [keyed.where(F.col("key") % 2 == i) for i in range(2)]
    got = L.linked(slices, meta, lambda ids: items.join(ids, "id"), percent, Scratch(spark, "test")).collect()
    root = {r.node: r.component for r in got}
    return {i: root.get(i, i) for i in sets}


def brute(sets, percent):
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in sets:
        for j in sets:
            a, b = set(sets[i]), set(sets[j])
            if i < j and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                root[y] = x
    return {i: find(i) for i in sets}


SETS = [{1: U, 2: A, 3: H}, {1: U, 2: A, 3: H, 4: range(2, 102), 5: range(300, 400)}]


@pytest.mark.parametrize(("sets", "few"), [(SETS[0], 1), (SETS[1], 1), (SETS[1], 8)])
def test_a_link_to_the_reference_counts(spark, monkeypatch, sets, few):
    """All share one key, whose hub (the smallest id) links to nothing."""
    monkeypatch.setattr(L, "FEW", few)
    assert linked(spark, sets, 90) == {i: 2 if i in (2, 3, 4) else i for i in sets}


def test_a_crowd_below_one_key(spark, monkeypatch):
    """Families of near copies of several centres, and loners, below one key; by turns of hubs, then by pairs."""
    rng = random.Random(1)
    monkeypatch.setattr(L, "PAIRS", 0.5)
    monkeypatch.setattr(L, "TURNS", 2)
    sets = {}
    for _ in range(6):
        centre = rng.sample(range(3000), 40)
        for _ in range(12):
            some = set(centre)
            for _ in range(rng.randint(0, 6)):
                some.discard(rng.choice(centre))
                some.add(rng.randrange(3000))
            sets[len(sets) + 1] = sorted(some)
    want = brute(sets, 80)
    assert linked(spark, sets, 80) == want
    assert len(set(want.values())) > 6 and sum(want[i] != i for i in want) > 20


def test_sketches_never_exceed_the_difference(spark):
    rng = np.random.default_rng(3)
    rows = []
    for n in (1, 5, 200, 500, 3000):
        a = rng.integers(0, 2**63, n).astype(np.uint64)
        for gone, more in ((0, 0), (1, 2), (n // 3, n // 4), (n, n // 8)):
            b = np.concatenate((a[gone:], rng.integers(0, 2**63, more).astype(np.uint64)))
            rows.append([parity_sketch(x).view(np.int64).tolist() for x in (a, b)] + [gone + more])
    df = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, d int")
    got = [(r.bits, r.d) for r in df.select(L.odd_bits("a", "b").alias("bits"), "d").collect()]
    assert all(bits <= d for bits, d in got) and all(bits == 0 for bits, d in got if d == 0)
    assert sum(bits > d / 3 for bits, d in got) > len(got) / 2


def test_near_and_far_members_of_a_key(spark, monkeypatch):
    """Members with most, some and hardly any of a reference's elements, in families, below one key; and how many elements are listed."""
    rng = random.Random(4)
    monkeypatch.setattr(L, "PAIRS", 0.5)
    listed, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        listed[name] = listed.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    sets, top = {}, 1000
    for share in [100] * 8 + [0, 10, 30, 60, 78, 80, 82, 90] * 2:
        centre = rng.sample(range(100), share) + list(range(top, top + 100 - share))
        top += 100
        for _ in range(4):
            some = centre[rng.randint(0, 12) :] + list(range(top, top + rng.randint(0, 12)))
            top += 12
            sets[len(sets) + 1] = some
    want = brute(sets, 80)
    assert linked(spark, sets, 80) == want
    assert len(set(want.values())) > 12 and sum(want[i] != i for i in want) > 40
    listed.clear()
    loners = {i: list(range(9)) + list(range(1000 * i, 1000 * i + 91)) for i in range(101, 161)}
    crowd = {i: range(100) for i in range(1, 11)} | loners
    assert linked(spark, crowd, 80) == {i: 1 if i <= 10 else i for i in crowd}
    # Elements that only the reference has are not listed for those that lie far from it.
    assert listed["open"] >= 60 and listed["shared"] <= len(crowd) and listed["ranked"] <= len(crowd)


def test_few_edges_and_many(spark, monkeypatch):
    """Components found on the driver are those of the distributed rounds, also where these end in few edges."""
    rng = random.Random(6)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(120)] + [(i, i + 1) for i in range(1000, 1060)]
    want = brute({i: {0} if i < 0 else {i} for i in {x for e in edges for x in e}}, 100)
    for a, b in edges * 60:
        want[a] = want[b] = min(want[a], want[b])
    want = {i: c for i, c in want.items() if any(i in e and e[0] != e[1] for e in edges)}
    for small in (0, 5, 10**6):
        monkeypatch.setattr(L, "SMALL", small)
        got = L.components(spark.createDataFrame(edges, "a bigint, b bigint"), Scratch(spark, "test")).collect()
        assert {r.node: r.component for r in got} == want and len(got) == len(want)


def test_copies_and_reads_of_the_deltas(spark, monkeypatch):
    """Copies take no part in the rounds of labels and come back in the end; deltas are joined with their pairs once."""
    listed, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        listed[name] = [*listed.get(name, []), (df._jdf.queryExecution().optimizedPlan().toString(), out.count())]
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    rng = random.Random(9)
    sets = {i: range(100) if i <= 10 else rng.sample(range(40), 20) + list(range(1000 * i, 1000 * i + 80)) for i in range(1, 31)}
    sig = {i: 1 if i <= 10 else i for i in sets}
    rows = [(i, len(s), bytearray(b"%d" % sig[i]), parity_sketch(np.array(list(s), np.uint64)).view(np.int64).tolist()) for i, s in sets.items()]
    meta = spark.createDataFrame(rows, "id bigint, n bigint, sig binary, sketch array<bigint>")
    keys = spark.createDataFrame([(i, 7, True) for i in sets], "id bigint, key bigint, chosen boolean")
    items = spark.createDataFrame([(i, 0, list(s)) for i, s in sets.items()], "id bigint, part int, items array<bigint>")
    got = {r.node: r.component for r in L.linked([keys], meta, lambda ids: items.join(ids, "id"), 80, Scratch(spark, "test")).collect()}
    assert {i: got.get(i, i) for i in sets} == {i: 1 if i <= 10 else i for i in sets}
    assert "labels" not in listed and all(n == 0 for _, n in listed["edges"]) and len(listed["flagged"]) == 1
    assert all("Join Inner, ((a" not in plan for name in ("seen", "shared") for plan, _ in listed[name])


PHRASE = list(range(9)) + list(range(5000, 5030))
CROWD = {i: range(100) for i in range(1, 11)} | {i: PHRASE + list(range(1000 * i, 1000 * i + 61)) for i in range(101, 161)}


def test_frequent_elements_of_far_members_are_not_listed(spark, monkeypatch):
    """Far members of a reference share a stock phrase that it lacks: neither that nor what only one of them has is listed."""
    listed, save = {}, Scratch.save

    def counted(self, df, name):
        out = save(self, df, name)
        listed[name] = listed.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(Scratch, "save", counted)
    assert linked(spark, CROWD, 80) == {i: 1 if i <= 10 else i for i in CROWD}
    assert listed["open"] >= 60 and listed["flagged"] == 0 and listed["shared"] == 0


def test_any_order_of_elements_gives_the_same_links(spark, monkeypatch):
    """Families that share a stock phrase, with so few counters that frequent elements look like rare ones."""
    monkeypatch.setattr(L, "SLOTS", 16)
    monkeypatch.setattr(L, "PAIRS", 0.5)
    rng = random.Random(8)
    families = {}
    for i in range(24):
        own = list(range(1_000_000 * (1 + i // 3), 1_000_000 * (1 + i // 3) + 61))
        families[200 + i] = PHRASE + own[rng.randint(0, 14) :] + list(range(90_000_000 + 20 * i, 90_000_000 + 20 * i + rng.randint(0, 8)))
    sets = CROWD | families
    want = brute(sets, 80)
    assert linked(spark, sets, 80) == want and sum(want[i] != i for i in families) > 6
