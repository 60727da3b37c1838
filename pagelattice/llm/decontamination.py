"""Operator 1: benchmark decontamination by greedy string tiling.

Documents and benchmark items are sequences of word hashes. Seeds are runs of MINIMUM words that both
share. For each candidate, the longest common run of words that are not yet covered is marked again and
again (running Karp-Rabin: seeds of equal hash are joined along their diagonals), so tiles never
overlap and may come in any order. The share of an item's words that the tiles cover decides.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, hash_words, narrow, ngram_hashes, pieces

#: Words of a seed and of the shortest tile.
MINIMUM = 5
#: Share of an item's words covered by tiles from which a document is contaminated by it.
COVERAGE = 0.5
#: Words of benchmark items in one block; a block is what is broadcast (16 bytes a word), whatever the size.
BLOCK_WORDS = 1_000_000

_WORD = re.compile(r"\w+")


def words(text: str | None) -> np.ndarray:
    """Hashes of the words, without case and punctuation."""
    return hash_words([w.encode("utf-8", "surrogatepass") for w in _WORD.findall(text.lower())] if text else [])


def tiles(item: np.ndarray, doc: np.ndarray, seeds: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Greedy tiling: (item start, doc start, length) of non-overlapping common runs, longest first.

    seeds: all (i, j) at which item and doc share MINIMUM words.
    """
    runs: list[tuple[int, int, int]] = []
    by_diagonal = defaultdict(list)
    for i, j in seeds:
        by_diagonal[j - i].append(i)
    for gap, starts in by_diagonal.items():
        starts.sort()
        first = last = starts[0]
        for i in [*starts[1:], -1]:
            if i == last + 1:
                last = i
                continue
            runs.append((-(last - first + MINIMUM), first, first + gap))
            first = last = i
    heapify(runs)
    used_item, used_doc, out = np.zeros(len(item), bool), np.zeros(len(doc), bool), []
    while runs:
        length, i, j = heappop(runs)
        n = -length
        free = ~(used_item[i : i + n] | used_doc[j : j + n])
        if free.all():
            used_item[i : i + n] = used_doc[j : j + n] = True
            out.append((i, j, n))
            continue
        # Parts that longer tiles have left come back with their own lengths.
        edges = np.flatnonzero(np.diff(np.concatenate(([0], free.view(np.int8), [0]))))
        for a, b in zip(edges[::2], edges[1::2], strict=True):
            if b - a >= MINIMUM:
                heappush(runs, (-int(b - a), i + int(a), j + int(a)))
    return out


class Seeds:
    """Sorted seed hashes of a block of items and where they start."""

    def __init__(self, items: dict[int, np.ndarray]):
        self.items = items
        hashes, owner, place = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        for key, item in items.items():
            h = ngram_hashes(item, MINIMUM)
            hashes.append(h)
            owner.append(np.full(len(h), key))
            place.append(np.arange(len(h)))
        h = np.concatenate(hashes)
        order = np.argsort(h, kind="stable")
        self.hashes, self.owner, self.place = h[order], np.concatenate(owner)[order], np.concatenate(place)[order]

    def matches(self, doc: np.ndarray) -> dict[int, list[tuple[int, int]]]:
        """Seeds (item position, doc position) by item."""
        h = ngram_hashes(doc, MINIMUM)
        out: dict[int, list[tuple[int, int]]] = defaultdict(list)
        if not len(self.hashes) or not len(h):
            return out
        at = np.searchsorted(self.hashes, h)
        hit = np.flatnonzero(self.hashes[np.minimum(at, len(self.hashes) - 1)] == h)
        for j in hit.tolist():
            i = at[j]
            while i < len(self.hashes) and self.hashes[i] == h[j]:
                out[int(self.owner[i])].append((int(self.place[i]), j))
                i += 1
        return out


def blocks_of(benchmark: DataFrame) -> Iterator[tuple[list[int | None], list[np.ndarray]]]:
    """Ids and word hashes of the items, in blocks of bounded size (one item at least)."""
    names: list[int | None] = []
    items: list[np.ndarray] = []
    held = 0
    for row in benchmark.where("text is not null").orderBy("item_id", "text").toLocalIterator():
        item = words(row.text)
        if items and held + len(item) > BLOCK_WORDS:
            yield names, items
            names, items, held = [], [], 0
        names.append(row.item_id)
        items.append(item)
        held += len(item)
    if items:
        yield names, items


_SEEDS: dict[int, Seeds] = {}


def _tiled(shared, coverage: float):  # noqa: ANN001
    key = shared.value[0], len(shared.value[1])
    key = hash((tuple(key[0]), sum(int(x.sum(dtype=np.uint64)) for x in shared.value[1])))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, items = shared.value
        if key not in _SEEDS:
            _SEEDS.clear()
            _SEEDS[key] = Seeds(dict(enumerate(items)))
        seeds = _SEEDS[key]
        for batch in pieces(batches):
            rows = []
            for doc_id, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                doc = words(text)
                for nth, starts in sorted(seeds.matches(doc).items()):
                    got = tiles(items[nth], doc, starts)
                    covered, n = sum(t[2] for t in got), len(items[nth])
                    if covered >= coverage * n:
                        rows.append((doc_id, names[nth], len(got), covered, n, covered / n))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.float64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, kinds, strict=True)],
                ["doc_id", "item_id", "n_tiles", "covered", "n_words", "coverage"],
            )

    return run


def contamination(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE) -> DataFrame:
    """One row per contaminated document and item: (doc_id, item_id, n_tiles, covered, n_words, coverage).

    Items of fewer than MINIMUM words, null and empty items match nothing; null and empty texts are
    clean; repeated rows give a row each; null ids are kept as null; other columns are ignored. Ties
    between tiles of one length go to the earlier place in the item, then in the document. The
    benchmark is worked on in blocks of bounded size, each a pass over the documents.
    """
    base = narrow(docs, "doc_id", "text")
    spark = docs.sparkSession
    schema = "doc_id bigint, item_id bigint, n_tiles int, covered int, n_words int, coverage double"
    out = None
    for names, items in blocks_of(narrow(benchmark, "item_id", "text")):
        shared = spark.sparkContext.broadcast((names, items))
        found = base.mapInArrow(_tiled(shared, coverage), schema)
        out = found if out is None else out.unionByName(found)
    return out if out is not None else spark.createDataFrame([], schema)
