"""Operator 6: n-gram Jaccard join by vertical partitioning.

The global order of n-grams (by hash) is cut into fragments. For two sets that link, the symmetric
difference D is bounded by their sizes; cut into D + 1 + M fragments, at least M + 1 fragments are the
same in both. So a set may leave out M fragments of its choice (those made only of n-grams that are
frequent in the corpus) and still meets every partner in an equal fragment. Overlaps of a candidate are
then counted fragment by fragment and summed per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, long_lists, mix, narrow, parity_sketch, pieces, shingle_set, word_ids
from .links import linked

#: Sets are grouped by size into classes of this ratio; each class has its own number of fragments.
CLASS_RATIO = 1.5
#: One fragment is added, and may be left out, for each SPARE that may differ.
SPARE = 4
#: Orders tried for a set with too many empty fragments, before empty fragments count as equal.
ORDERS = 4
#: N-grams in a partition's summary, in the broadcast table (8 bytes each), and how often they occur at least.
SUMMARY = 16_384
FREQUENT = 131_072
SEEN = 16
#: Slices of the keys; more of them need less disk and read the keys more often.
SLICES = 4
#: Fragments in which overlaps of a candidate pair are counted.
PARTS = 4


def class_bounds(up_to: int) -> list[int]:
    """Upper sizes of the classes: every size is in the first class whose bound is not below it."""
    bounds = [1]
    while bounds[-1] < up_to:
        bounds.append(max(bounds[-1] + 1, int(bounds[-1] * CLASS_RATIO)))
    return bounds


_BOUNDS = class_bounds(1 << 40)


def fragment_keys(items: np.ndarray, percent: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, spare) of a sorted set: of two sets of percent % Jaccard or more, one has a key that the other
    has as a key or as a spare.

    With J >= p and s <= t, D <= s (1 - p) / p, so class c (s up to bound b) is cut into
    D + 1 + M fragments with D = b (1 - p) / p. A set joins as the smaller side in its own class, and in
    the class below as the larger side if a partner can lie there. A set leaves out its empty fragments
    and frequent ones, M at most; one with more empty ones also takes part in the next order, as does
    every partner that it could only meet there.
    """
    n = len(items)
    none = np.empty(0, np.uint64)
    if not n:
        return none, none
    own = int(np.searchsorted(_BOUNDS, n))
    levels = [own]
    low = own - 1
    while low >= 0 and 100 * _BOUNDS[low] >= percent * n:
        levels.append(low)
        low -= 1
    rare = np.ones(n, bool)
    if len(frequent):
        rare = frequent[np.minimum(np.searchsorted(frequent, items), len(frequent) - 1)] != items
    kept, spared = [none], [none]
    for level in levels:
        most = _BOUNDS[level] * (100 - percent) // percent
        leave = -(-most // SPARE)
        count = most + 1 + leave
        for order in range(ORDERS):
            spread = mix(items ^ np.uint64((order * 0x5851F42D4C957F2D + 1) % (1 << 64)))
            slot = (((spread >> np.uint64(32)) * np.uint64(count)) >> np.uint64(32)).astype(np.int64)
            filled = np.bincount(slot, minlength=count)
            weak = np.bincount(slot[rare], minlength=count) == 0
            sums = np.zeros(count, np.uint64)
            np.add.at(sums, slot, mix(spread))
            place = np.arange(count, dtype=np.uint64) + np.uint64((level * ORDERS + order) << 48)
            keys = mix(sums ^ mix(place))
            empty = count - np.count_nonzero(filled)
            if empty > leave and order == ORDERS - 1:
                kept.append(keys)
                break
            left_out = np.flatnonzero(weak & (filled > 0))[: max(0, leave - empty)]
            use = filled > 0
            use[left_out] = False
            kept.append(keys[use])
            spared.append(keys[left_out])
            if empty <= leave:
                break
    return np.concatenate(kept), np.concatenate(spared)


def _counted(n: int):
    """The n-grams that many documents of a partition hold: a summary of bounded size."""

    def pruned(held: tuple[np.ndarray, np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray]:
        items, counts = held
        if len(items) > most:
            best = np.argpartition(-counts, most)[:most]
            items, counts = items[best], counts[best]
        return items, counts

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.empty(0, np.uint64), np.empty(0, np.int64))
        for batch in pieces(batches):
            sets = [shingle_set(word_ids(t), n) for t in column(batch, "text")]
            items, counts = np.unique(np.concatenate([np.empty(0, np.uint64), *sets]), return_counts=True)
            many = counts > 1
            items = np.concatenate([held[0], items[many]])
            counts = np.concatenate([held[1], counts[many]])
            items, at = np.unique(items, return_inverse=True)
            held = pruned((items, np.bincount(at, counts, len(items)).astype(np.int64)), 8 * SUMMARY)
        items, counts = pruned(held, SUMMARY)
        yield pa.RecordBatch.from_arrays([pa.array(items.view(np.int64)), pa.array(counts)], ["item", "seen"])

    return run


def frequent_ngrams(docs: DataFrame, n: int) -> np.ndarray:
    """Sorted hashes of at most FREQUENT n-grams, the most frequent ones of the partitions' summaries.

    They only decide which fragments are left out, never whether two documents link.
    """
    seen = docs.select("text").mapInArrow(_counted(n), "item bigint, seen bigint")
    total = seen.groupBy("item").agg(F.sum("seen").alias("seen")).where(F.col("seen") >= SEEN)
    top = total.orderBy(F.desc("seen"), "item").limit(FREQUENT).toPandas()["item"].to_numpy(np.int64)
    return np.sort(top.view(np.uint64))


def _keyed(n: int, percent: int, frequent: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = frequent.value
        for batch in pieces(batches):
            sets = [shingle_set(word_ids(t), n) for t in column(batch, "text")]
            keys = [fragment_keys(s, percent, known) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()),
                    long_lists([parity_sketch(s) for s in sets]),
                    long_lists([k for k, _ in keys]),
                    long_lists([k for _, k in keys]),
                ],
                ["id", "n", "sig", "sketch", "keys", "spare"],
            )

    return run


def _parts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cuts = np.array([(j << 64) // PARTS for j in range(1, PARTS)], np.uint64)
        for batch in pieces(batches):
            ids, parts, items = [], [], []
            for doc, text, sig in zip(column(batch, "id"), column(batch, "text"), column(batch, "sig"), strict=True):
                s = shingle_set(word_ids(text), n)
                if xxhash.xxh3_128_digest(s.tobytes()) != sig:
                    continue
                for part, some in enumerate(np.split(s, np.searchsorted(s, cuts))):
                    ids.append(doc)
                    parts.append(part)
                    items.append(some)
            if ids:
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids, pa.int64()), pa.array(parts, pa.int32()), long_lists(items)], ["id", "part", "items"]
                )

    return run


def ngram_jaccard_components(docs: DataFrame, n: int = 5, percent: int = 80) -> DataFrame:
    """One row per doc_id: (doc_id, n_shingles, component_id).

    Two documents link when 100 * |A n B| >= percent * |A u B| over their sets of n-word shingles;
    component_id is the smallest doc_id reachable by links. Null or empty texts have an empty set and
    link with nothing. A null doc_id comes back with a null component. Rows that repeat a doc_id count
    once; if their texts differ, the one with the smallest set signature stands for the document.
    Other columns, whatever their names, are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "ngram_join")
    base = narrow(docs, "doc_id", "text")
    frequent = spark.sparkContext.broadcast(frequent_ngrams(base, n))
    keyed = base.mapInArrow(
        _keyed(n, percent, frequent),
        "id bigint, n bigint, sig binary, sketch array<bigint>, keys array<bigint>, spare array<bigint>",
    )
    keyed = scratch.save(keyed, "keyed")
    meta = keyed.where("id is not null").groupBy("id").agg(F.min(F.struct("sig", "n", "sketch")).alias("m"))
    meta = scratch.save(meta.select("id", "m.sig", "m.n", "m.sketch"), "meta")

    def fragments(ids: DataFrame) -> DataFrame:
        wanted = meta.join(ids, "id").select("id", "sig")
        rows = base.select(F.col("doc_id").alias("id"), "text").join(wanted, "id").select("id", "text", "sig")
        cut = rows.mapInArrow(_parts(n), "id bigint, part int, items array<bigint>")
        return cut.groupBy("id", "part").agg(F.first("items").alias("items"))

    nulls = scratch.save(keyed.where("id is null").select("id", "n"), "nulls")
    keys = keyed.where("id is not null").select("id", "keys", "spare")
    keys = keys.select("id", F.explode("keys").alias("key"), F.lit(True).alias("chosen")).unionByName(
        keys.select("id", F.explode("spare").alias("key"), F.lit(False).alias("chosen"))
    )
    slices = [keys.where(F.pmod("key", F.lit(SLICES)) == i) for i in range(SLICES)]
    labels = linked(slices, meta, fragments, percent, scratch, spent=keyed)
    nulls = nulls.select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.lit(None).cast("bigint").alias("component_id")
    )
    known = meta.join(labels.withColumnRenamed("node", "id"), "id", "left").select(
        F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.coalesce("component", "id").alias("component_id")
    )
    return known.unionByName(nulls)
