"""Operator 7: removal of repeated substrings by longest previous factors in suffix order.

A string of `length` bytes that occurs twice has the same smallest k-gram hash at the same place (its
anchor), so only strings with equal anchors have to be compared. Starts that share an anchor form a
run; equal runs repeat as a whole. Different runs of one anchor go into blocks of bounded size, whose
suffixes are sorted: the longest previous factor of a place is what it shares with the nearest smaller
places before and after it in suffix order, and one of `length` bytes is an earlier match. An anchor with very many
different runs is not gathered: bands of its starts meet by 128-bit hashes of what all strings of a band
share and of what they cover, and only bands that share the one but not the other are cut finer.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import Scratch, column, mix, narrow, pieces, powers, prefix_sums, utf8

#: Bytes of a block whose suffixes are sorted together (at least; an anchor's runs stay together).
BLOCK_BYTES = 1 << 20
#: Different runs of one anchor up to which they go into a block.
GATHERED = 1024
#: Widths of the bands of starts that are compared for an anchor with more runs.
BANDS = (64, 16, 4, 1)
#: Starts of a text that are worked on at once.
STEP = 1 << 18

_PLACE = np.uint64((1 << 20) - 1)


def anchor_runs(data: bytes, length: int) -> tuple[np.ndarray, ...]:
    """(first start, last start, anchor place, anchor hash, run hash) of every run of starts."""
    got = [_anchor_runs(data[at : at + STEP + length - 1], length, at) for at in range(0, len(data) - length + 1, STEP)]
    if not got:
        none = np.empty(0, np.int64)
        return none, none, none, none.view(np.uint64), none.view(np.uint64)
    return tuple(np.concatenate(part) for part in zip(*got, strict=True))


def _anchor_runs(data: bytes, length: int, shift: int) -> tuple[np.ndarray, ...]:
    n = len(data)
    gram = max(1, length // 4)
    down = powers(n + 1)[1]
    sums = prefix_sums(data)
    grams = mix((sums[gram:] - sums[:-gram]) * down[: n - gram + 1])
    # Smallest hash of each stretch of `wide` grams, the leftmost on ties: blockwise running minima.
    wide = length - gram + 1
    packed = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
    rows = np.concatenate((packed, np.full(-len(packed) % wide, np.uint64(2**64 - 1)))).reshape(-1, wide)
    ahead = np.minimum.accumulate(rows, axis=1).ravel()
    behind = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    starts = n - length + 1
    place = (np.minimum(behind[:starts], ahead[wide - 1 : wide - 1 + starts]) & _PLACE).astype(np.int64)
    cut = np.flatnonzero(np.diff(place)) + 1
    first = np.concatenate(([0], cut))
    last = np.concatenate((cut, [starts])) - 1
    at = place[first]
    end = last + length
    run = mix((sums[end] - sums[first]) * down[first]) ^ mix(((at - first) * 1_000_003 + (end - first)).astype(np.uint64))
    return first + shift, last + shift, at + shift, grams[at], run


def smaller_before(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it whose (distinct) value is smaller; -1 where there is none."""
    to = np.arange(-1, len(values) - 1)
    todo = np.flatnonzero(to >= 0)
    while len(todo):
        # What lies between a place and its pointer is larger than it, so a larger place's pointer can be taken over.
        todo = todo[values[to[todo]] > values[todo]]
        to[todo] = to[to[todo]]
        todo = todo[to[todo] >= 0]
    return to


def longest_previous(order: np.ndarray, rank: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factors, up to `length` and 0 below it, of the places in suffix order.

    The factor of a place is the longer of those that it shares with the previous and the next smaller place
    in suffix order; rank is the rank of each place's first `length` bytes.
    """
    n, found = len(order), np.zeros(len(order), np.int32)
    before, after = smaller_before(order), n - 1 - smaller_before(order[::-1])[::-1]
    for other in (before, after):
        there = np.flatnonzero((other >= 0) & (other < n))
        there = there[rank[order[there]] == rank[order[other[there]]]]
        found[there] = length
    return found


def matched_starts(segments: list[bytes], length: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each segment, per start of `length` bytes: is the string elsewhere too, and is it earlier.

    Ranks of prefixes of 8, 24, 72, ... bytes by sorting, up to the rank of the whole length, give the suffix
    order. A string with a longest previous factor of its own length is an earlier one's copy; the same in the
    text read backwards, from the last place on, tells those that come again.
    """
    text = np.frombuffer(b"".join(segments) + bytes(8), np.uint8).astype(np.uint64)
    n = len(text) - 8
    ends = np.cumsum([len(s) for s in segments])
    key = np.zeros(n, np.uint64)
    for j in range(8):
        key = (key << np.uint64(8)) | text[j : n + j]
    depth = 8

    def ranked(values: np.ndarray) -> np.ndarray:
        return np.unique(values, return_inverse=True)[1].astype(np.uint64).ravel()

    def ahead(values: np.ndarray, by: int) -> np.ndarray:
        return np.concatenate((values[by:], np.zeros(min(by, n), np.uint64)))[:n]

    if length < 8:
        key, depth = key >> np.uint64(8 * (8 - length)), length
    rank = ranked(key)
    while depth * 3 <= length and n < 1 << 21:
        rank = ranked((rank << np.uint64(42)) | (ahead(rank, depth) << np.uint64(21)) | ahead(rank, 2 * depth))
        depth *= 3
    while depth < length:
        by = min(depth, length - depth)
        rank = ranked((rank << np.uint64(32)) | ahead(rank, by))
        depth += by
    starts = np.concatenate([np.arange(e - len(s), e - length + 1) for s, e in zip(segments, ends, strict=True)])
    order = starts[np.argsort(rank[starts], kind="stable")]
    earlier, later = np.zeros(n, bool), np.zeros(n, bool)
    earlier[order] = longest_previous(order, rank, length) > 0
    mirrored = n - 1 - order
    later[order] = longest_previous(mirrored, rank[::-1], length) > 0
    other = earlier | later
    return [
        (other[e - len(s) : e - length + 1], earlier[e - len(s) : e - length + 1])
        for s, e in zip(segments, ends, strict=True)
    ]


def _intervals(mask: np.ndarray) -> list[int]:
    return np.flatnonzero(np.diff(np.concatenate(([0], mask.view(np.int8), [0])))).tolist()


def _occurrences(length: int):
    names = ["doc_id", "text_key", "anchor", "run", "first", "last", "place"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            found = [anchor_runs(utf8(t), length) for t in column(batch, "text")]
            many = [len(f[0]) for f in found]
            ids = np.repeat(np.array(column(batch, "doc_id"), np.int64), many)
            keys = np.repeat(np.array(column(batch, "text_key"), np.int64), many)
            first, last, place, anchor, run = (np.concatenate(x) for x in zip(*found, strict=True))
            arrays = [ids, keys, anchor.view(np.int64), run.view(np.int64)] + [x.astype(np.int32) for x in (first, last, place)]
            yield pa.RecordBatch.from_arrays([pa.array(a) for a in arrays], names)

    return run


def _segments(length: int):
    names = ["anchor", "run", "big", "doc_id", "text_key", "first", "offset", "bytes"]
    kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows = []
            for doc, key, text, wanted in zip(*(column(batch, c) for c in ("doc_id", "text_key", "text", "wanted")), strict=True):
                data = utf8(text)
                for w in wanted:
                    part = data[w["first"] : w["last"] + length]
                    rows.append((w["anchor"], w["run"], w["big"], doc, key, w["first"], w["place"] - w["first"], part))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _compared(length: int):
    def block(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
        got = matched_starts([r[2] for r in rows], length)
        keep = [(r[0], r[1], _intervals(o), _intervals(e)) for r, (o, e) in zip(rows, got, strict=True) if o.any()]
        cols = list(zip(*keep, strict=True)) if keep else [()] * 4
        kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32())]
        arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(arrays, ["anchor", "run", "other", "earlier"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[int, int, bytes]] = []
        size = 0
        for batch in batches:
            for anchor, r, data in zip(*(column(batch, c) for c in ("anchor", "run", "bytes")), strict=True):
                if held and held[-1][0] != anchor and size >= BLOCK_BYTES:
                    yield block(held)
                    held, size = [], 0
                if not held or held[-1][:2] != (anchor, r):  # a repeated row of documents gives a run twice
                    held.append((anchor, r, data))
                    size += len(data)
        if held:
            yield block(held)

    return run


def _bands(length: int, width: int):
    """Bands of starts, by their distance to the anchor: a run's part of each aligned band of `width` distances."""
    names = ["anchor", "run", "doc_id", "text_key", "first", "offset", "bytes", "lo", "hi", "band", "c1", "c2", "v1", "v2"]
    kinds = [pa.int64()] * 4 + [pa.int32()] * 2 + [pa.binary()] + [pa.int32()] * 3 + [pa.int64()] * 4

    def two(data: bytes) -> tuple[int, int]:
        return tuple(np.frombuffer(xxhash.xxh3_128_digest(data), np.int64).tolist())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 64):
            rows = []
            for row in zip(*(column(batch, c) for c in names[:9]), strict=True):
                offset, data, lo, hi = row[5:9]
                for band in range(lo // width, (hi - 1) // width + 1):
                    a, b = max(lo, band * width), min(hi, (band + 1) * width)
                    # what every string of the whole band has: it lies within the run, as the run meets the band
                    core = data[offset - band * width : offset - (band + 1) * width + 1 + length]
                    cover = data[offset - b + 1 : offset - a + length]
                    rows.append((*row[:7], a, b, band, *two(core), *two(b"%d " % a + cover)))
            cols = list(zip(*rows, strict=True)) if rows else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names)

    return run


def _banded(segments: DataFrame, length: int, scratch: Scratch) -> DataFrame:
    """(anchor, run, other, earlier) by bands of starts, wide ones first.

    Bands with equal covers repeat as a whole; of those, one goes on to finer bands if another run
    shares the band's core but not the cover. Bands whose core nobody shares hold nothing.
    """
    keys = "anchor bigint, run bigint, doc_id bigint, text_key bigint, first int, offset int, bytes binary, lo int, hi int"
    schema = keys + ", band int, c1 bigint, c2 bigint, v1 bigint, v2 bigint"
    n = F.octet_length("bytes") - length  # starts of a run, less one
    todo = segments.select(
        "anchor", "run", "doc_id", "text_key", "first", "offset", "bytes",
        (F.col("offset") - n).alias("lo"), (F.col("offset") + 1).alias("hi"),
    )
    where = F.struct("doc_id", "text_key", "first")
    core, cover = ["anchor", "band", "c1", "c2"], ["anchor", "band", "c1", "c2", "v1", "v2"]
    found = []
    for width in (w for w in BANDS if 2 * w <= length or w == 1):
        level = scratch.save(todo.mapInArrow(_bands(length, width), schema).dropDuplicates(["anchor", "run", "band"]), "bands")
        cores = level.groupBy(*core).agg(F.min("run").alias("a"), F.max("run").alias("b")).where("a < b").select(*core)
        cores = scratch.save(cores, "cores")
        level = level.join(cores, core)
        covers = level.groupBy(*cover).agg(F.count("*").alias("many"), F.min(where).alias("least"))
        covers = scratch.save(covers, "covers")
        several = covers.groupBy(*core).agg(F.count("*").alias("kinds")).where("kinds > 1").select(*core, F.lit(True).alias("go"))
        level = scratch.save(level.join(covers, cover).join(scratch.save(several, "several"), core, "left"), "level")
        both = F.array("lo", "hi")
        found.append(
            level.where("many > 1").select("anchor", "run", "offset", both.alias("other"), F.when(where > F.col("least"), both).alias("earlier"))
        )
        todo = level.where(F.col("go") & (where == F.col("least"))).select(
            "anchor", "run", "doc_id", "text_key", "first", "offset", "bytes", "lo", "hi"
        )
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    # From distances [lo, hi) to starts within the run.
    turned = lambda c: F.when(F.col(c).isNotNull(), F.array(F.col("offset") - F.col(c)[1] + 1, F.col("offset") - F.col(c)[0] + 1))
    every = every.select("anchor", "run", turned("other").alias("other"), turned("earlier").alias("earlier"))
    return every.groupBy("anchor", "run").agg(
        F.flatten(F.collect_list("other")).alias("other"), F.flatten(F.collect_list("earlier")).alias("earlier")
    )


def _removed(length: int, with_kept: bool):
    names = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"] + ["kept"] * with_kept
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            rows = []
            for doc, text, starts in zip(*(column(batch, c) for c in ("doc_id", "text", "starts")), strict=True):
                data = utf8(text)
                spans: list[int] = []
                for a, b in sorted(zip(starts[::2], starts[1::2], strict=True)) if starts else ():
                    if spans and a <= spans[-1]:
                        spans[-1] = max(spans[-1], b - 1 + length)
                    else:
                        spans += [a, b - 1 + length]
                edges = [0, *spans, len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                sha = hashlib.sha256(kept).hexdigest()
                rows.append((doc, len(data), len(data) - len(kept), len(spans) // 2, sha, spans, kept))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 7
            arrays = [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)][: len(names)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def remove_repeats(docs: DataFrame, length: int = 400, keep_first: bool = False, with_kept: bool = False) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_removed, n_spans, kept_sha256, spans[, kept]).

    Removes every byte covered by a string of `length` bytes that also starts elsewhere, in the same text
    or another; with keep_first only the copies after the first (by doc_id, then place). Spans are the
    maximal removed runs, as start, end, start, end... in UTF-8 bytes; kept is what remains.

    A null text is empty. Rows that repeat a text repeat all its strings; rows that repeat doc_id and text
    both are one place for keep_first. A null doc_id is allowed and comes first. Other columns are ignored.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "repeats")
    least = -(1 << 63)
    base = narrow(docs, "doc_id", "text").select(
        F.coalesce("doc_id", F.lit(least)).alias("doc_id"), F.coalesce("text", F.lit("")).alias("text")
    )
    base = base.withColumn("text_key", F.xxhash64("text"))
    occurrences = base.mapInArrow(
        _occurrences(length),
        "doc_id bigint, text_key bigint, anchor bigint, run bigint, first int, last int, place int",
    )
    occurrences = scratch.save(occurrences, "occurrences")
    anchors = occurrences.groupBy("anchor").agg(F.count("*").alias("all"), F.min("run").alias("lo"), F.max("run").alias("hi"))
    # Written first, so that the join below has two plain exchanges, whose hot keys can be split.
    anchors = scratch.save(anchors.where("all > 1").select("anchor", (F.col("lo") < F.col("hi")).alias("mixed")), "anchors")
    shared = scratch.save(occurrences.join(anchors, "anchor"), "shared")
    scratch.drop(occurrences)
    runs = shared.groupBy("anchor", "run").agg(
        F.count("*").alias("many"), F.first("mixed").alias("mixed"),
        F.min(F.struct("doc_id", "text_key", "first", "last", "place")).alias("at"),
    )
    runs = scratch.save(runs, "runs")

    # Different runs of one anchor: each once, with its bytes.
    mixed = runs.where("mixed")
    big = mixed.groupBy("anchor").agg((F.count("*") > GATHERED).alias("big"))
    wanted = mixed.join(big, "anchor").select("anchor", "run", "big", "at.*")
    wanted = wanted.groupBy("doc_id", "text_key").agg(
        F.collect_list(F.struct("anchor", "run", "big", "first", "last", "place")).alias("wanted")
    )
    segments = base.join(wanted, ["doc_id", "text_key"]).mapInArrow(
        _segments(length),
        "anchor bigint, run bigint, big boolean, doc_id bigint, text_key bigint, first int, offset int, bytes binary",
    )
    segments = scratch.save(segments, "segments")
    order = ["anchor", "doc_id", "text_key", "first"]
    small = segments.where("not big").repartition("anchor").sortWithinPartitions(*order).select("anchor", "run", "bytes")
    schema = "anchor bigint, run bigint, other array<int>, earlier array<int>"
    found = small.mapInArrow(_compared(length), schema)

    found = scratch.save(found.unionByName(_banded(segments.where("big"), length, scratch)), "found")
    scratch.drop(segments)

    marks = runs.join(found, ["anchor", "run"], "left").where("many > 1 or other is not null")
    marks = scratch.save(marks.select("anchor", "run", "many", "at", "other", "earlier"), "marks")
    hit = shared.join(marks, ["anchor", "run"])
    whole = F.array(F.col("first"), F.col("last") + 1)
    shifted = lambda starts: F.transform(starts, lambda q: q + F.col("first"))
    if keep_first:
        is_first = F.struct("doc_id", "text_key", "first", "last", "place") == F.col("at")
        starts = F.when(~is_first, whole).otherwise(shifted("earlier"))
    else:
        starts = F.when(F.col("many") > 1, whole).otherwise(shifted("other"))
    hit = hit.select("doc_id", "text_key", starts.alias("starts")).where("starts is not null and size(starts) > 0")
    hit = hit.groupBy("doc_id", "text_key").agg(F.flatten(F.collect_list("starts")).alias("starts"))
    hit = scratch.save(hit, "starts")
    scratch.drop(shared, runs, found)
    schema = "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string, spans array<bigint>"
    out = base.join(hit, ["doc_id", "text_key"], "left").select("doc_id", "text", "starts")
    out = out.mapInArrow(_removed(length, with_kept), schema + ", kept binary" * with_kept)
    return out.withColumn("doc_id", F.when(F.col("doc_id") != least, F.col("doc_id")))
