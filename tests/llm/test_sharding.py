from pagelattice.llm.sharding import CommitConflict, ShardStore, sharded


def test_round_trip_through_tiers(table, tmp_path):
    rows = [(i, None if i % 7 == 0 else "" if i % 5 == 0 else "word " * i) for i in range(200)] + [(3, "word " * 3), (None, "x")]
    docs = table(rows).repartition(9)
    store = ShardStore(docs.sparkSession, f"file://{tmp_path}/s", target_bytes=1 << 20)
    assert store.append(docs) == 1
    small = store.manifest()["shards"]
    assert len(small) == 9
    store.append(docs.limit(10).coalesce(1))
    version = store.compact()
    assert version > 2 and len(store.manifest()["shards"]) < store.fan_in
    assert sorted(store.read(1).collect(), key=str) == sorted(docs.collect(), key=str)
    assert store.read().count() == docs.count() + 10
    assert store.read().columns == docs.columns
    assert store.vacuum() == 0 and store.read(1).count() == docs.count()  # within the time of grace
    assert store.vacuum(grace=0) >= 10
    assert store.read().count() == docs.count() + 10


def test_a_version_is_committed_once(table, tmp_path):
    docs = table([(1, "a")])
    store = ShardStore(docs.sparkSession, f"file://{tmp_path}/s")
    base = store.manifest()
    store.append(docs)
    try:
        store._commit(base, docs.schema.json(), {}, "late")
    except CommitConflict:
        pass
    else:
        raise AssertionError("a taken version was overwritten")
    assert store.latest() == 1 and store.read().count() == 1


def test_other_writers_lose_nothing(table, tmp_path):
    """One writes and is not done when another appends, compacts and vacuums; then the first one commits."""
    root = f"file://{tmp_path}/w"
    docs = table([(i, "word " * i) for i in range(40)])
    mine, other = ShardStore(docs.sparkSession, root), ShardStore(docs.sparkSession, root)
    mine.append(docs.repartition(5))
    commit, calls = mine._commit, []

    def late(base, *rest):
        calls.append(base["version"])
        if len(calls) == 1:
            other.append(docs.repartition(4))
            other.compact()
            other.vacuum(grace=0)
        return commit(base, *rest)

    mine._commit = late
    mine.append(docs.repartition(3))
    assert len(calls) == 2 and calls[1] > calls[0]
    assert mine.read().count() == 120
    calls.clear()
    mine.compact()
    assert mine.read().count() == 160 and sorted(mine.read().distinct().collect()) == sorted(docs.collect())


def test_empty_table(table, tmp_path):
    store = sharded(table([]), f"file://{tmp_path}/e")
    assert store.read().count() == 0


def test_tiers_grow_by_a_ratio(spark, tmp_path):
    store = ShardStore(spark, f"file://{tmp_path}/t")
    assert [store.tier(s) for s in (0, (1 << 20) - 1, 1 << 20, 4 << 20, 16 << 20)] == [0, 0, 1, 2, 3]
