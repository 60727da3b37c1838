"""Operator 10: repeated paragraphs by MinHash banding.

Paragraphs are stretches of words between boundaries that the words themselves decide (a pair of words whose
hash is the smallest for WINDOW places around), so a passage falls into the same paragraphs wherever it
stands, within a line or over several. They are sets of five-word shingles, those of fewer words one
shingle. Bands of MinHash values, tuned for a recall at the similarity asked for, bring likely copies
together; exact Jaccard decides; linked paragraphs form clusters of which the first is kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import ceil, log

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._common import Scratch, column, long_lists, mix, narrow, ngram_hashes, pieces, shingle_set, word_hashes, word_ids
from .links import linked

#: Share of pairs at the threshold that the bands must find, and the most hash functions to spend on it.
RECALL = 0.999
FUNCTIONS = 16
#: Places on either side among which a boundary has the smallest hash: paragraphs have more words than this, about
#: twice as many on average, and a passage holds a paragraph of its own from some 35 to 50 words on.
WINDOW = 8
#: Words that a stretch of repeated paragraphs has at least to be reported; shorter ones are stock phrases.
PASSAGE = 20


def tuned_bands(percent: int, recall: float = RECALL, functions: int = FUNCTIONS) -> tuple[int, int]:
    """(bands, rows): as many rows a band as the functions allow, with bands for the recall."""
    best = (ceil(log(1 - recall) / log(1 - percent / 100)), 1)
    for rows in range(2, 17):
        bands = ceil(log(1 - recall) / log(1 - (percent / 100) ** rows))
        if bands * rows <= functions:
            best = (bands, rows)
    return best


def boundaries(ids: np.ndarray, owner: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Which words begin a paragraph: ids are word hashes, owner the ascending number of each word's text.

    Besides the first word of a text, a word whose pair with the word before has a smaller hash than those of
    `window` places to either side, all of them in the same text.
    """
    n = len(ids)
    if not n:
        return np.zeros(0, bool)
    pair = np.zeros(n, np.uint64)
    pair[1:] = ngram_hashes(ids, 2)
    first, last = np.searchsorted(owner, owner, "left"), np.searchsorted(owner, owner, "right")
    place = np.arange(n)
    begins = (place - first > window) & (last - place > window)
    for k in range(1, min(window, n - 1) + 1):
        begins[k:] &= pair[k:] < pair[:-k]
        begins[:-k] &= pair[:-k] < pair[k:]
    return begins | (place == first)


def shingle_sets(ids: np.ndarray, sizes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(items, starts): the sorted distinct shingles of many paragraphs, one after the other, and where each begins.

    ids: the paragraphs' word hashes, one after the other; sizes: how many each has, one at least.
    """
    begins = np.cumsum(sizes) - sizes
    many = np.maximum(sizes - (n - 1), 0)
    owner = np.repeat(np.arange(len(sizes)), many)
    items = ngram_hashes(ids, n)[begins[owner] + np.arange(len(owner)) - (np.cumsum(many) - many)[owner]]
    short = np.flatnonzero(sizes < n)
    if len(short):
        items = np.concatenate([items, *[shingle_set(ids[begins[k] : begins[k] + sizes[k]], n) for k in short.tolist()]])
        owner = np.concatenate([owner, short])
    order = np.lexsort((items, owner))
    items, owner = items[order], owner[order]
    fresh = np.ones(len(items), bool)
    fresh[1:] = (items[1:] != items[:-1]) | (owner[1:] != owner[:-1])
    items, owner = items[fresh], owner[fresh]
    return items, np.searchsorted(owner, np.arange(len(sizes)))


def band_keys(items: np.ndarray, starts: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """A row of keys, one a band, for each set, from the smallest values of bands * rows hash functions."""
    seeds = mix(np.arange(2 * bands * rows, dtype=np.uint64))
    keys = np.empty((len(starts), bands), np.uint64)
    with np.errstate(over="ignore"):
        for band in range(bands):
            key = np.full(len(starts), mix(np.array([band], np.uint64))[0])
            for row in range(band * rows, (band + 1) * rows):
                key = mix(key ^ np.minimum.reduceat(items * (seeds[2 * row] | np.uint64(1)) + seeds[2 * row + 1], starts))
            keys[:, band] = key
    return keys


def signatures(items: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each set, which do not depend on an order."""
    with np.errstate(over="ignore"):
        return np.stack([np.add.reduceat(mix(items ^ np.uint64(salt)), starts) for salt in (0x51, 0xA7)], 1)


def _paragraphs(percent: int, n: int):
    bands, rows_a_band = tuned_bands(percent)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches):
            texts = [(t or "").encode("utf-8", "surrogatepass") for t in column(batch, "text")]
            data = b"\n".join(texts)
            ids, at = word_hashes(data)
            if not len(ids):
                continue
            sizes = np.array([len(t) + 1 for t in texts])
            begins = np.cumsum(sizes) - sizes
            owner = np.searchsorted(begins, at, "right") - 1
            head = np.flatnonzero(boundaries(ids, owner))
            many = np.diff(np.append(head, len(ids)))
            items, starts = shingle_sets(ids, many, n)
            text = owner[head]
            fresh = np.concatenate(([True], text[1:] != text[:-1]))
            number = np.arange(len(head)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
            # Code points before each byte; a text's first paragraph has what is before its first word, too.
            points = np.concatenate(([0], np.cumsum((np.frombuffer(data + b"\n", np.uint8) & 0xC0) != 0x80)))
            start = np.where(fresh, 0, points[at[head]] - points[begins[text]])
            end = np.append(start[1:], 0)
            final = np.append(fresh[1:], True)
            end[final] = (points[begins + sizes - 1] - points[begins])[text[final]]
            whose = pa.array(text)
            sig = signatures(items, starts)
            keys = band_keys(items, starts, bands, rows_a_band)
            parity = np.bitwise_xor.reduceat(np.uint64(1) << (items & np.uint64(63)), starts)
            values = [number, start, end, many, np.diff(np.append(starts, len(items))), sig[:, 0], sig[:, 1], parity, *keys.T]
            arrays = [pa.array(np.ascontiguousarray(v).view(np.int64)) for v in values]
            names = ["paragraph", "start", "end", "words", "n", "s1", "s2", "parity", *(f"key{i}" for i in range(bands))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(whose), batch.column(1).take(whose), *arrays], ["doc_id", "row_key", *names])

    return run


def _parts(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in pieces(batches, 128):
            ids, items = [], []
            for text, wanted in zip(column(batch, "text"), column(batch, "wanted"), strict=True):
                for w in wanted:
                    ids.append(w["id"])
                    items.append(shingle_set(word_ids((text or "")[w["start"] : w["end"]]), n))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), long_lists(items)], ["id", "items"])

    return run


def repeated_paragraphs(docs: DataFrame, percent: int = 80, n: int = 5, least_words: int = PASSAGE) -> DataFrame:
    """Every paragraph that repeats: (doc_id, paragraph, start, end, first_doc_id, first_paragraph, removed).

    All words of a text are in paragraphs (see above), and all paragraphs are compared. Two link when their
    sets of n-word shingles have a Jaccard similarity of percent % or more; a cluster is what links connect.
    Its first paragraph (by doc_id, then place) is kept, the others are marked removed. Reported are the
    paragraphs of clusters where they and those next to them in clusters have least_words words or more; 1
    reports all. Positions are code points; a paragraph ends where the next one begins. Exact copies are
    compared once. Paragraphs that repeat nothing do not appear, so documents without any are not in
    the result; null and empty texts have none; a null doc_id is allowed and comes first; rows that repeat a
    doc_id take part with each text; other columns are ignored.
    """
    scratch = Scratch(docs.sparkSession, "paragraphs")
    bands = tuned_bands(percent)[0]
    base = narrow(docs, "doc_id", "text").where("text is not null").select("doc_id", F.xxhash64("doc_id", "text").alias("row_key"), "text")
    schema = "doc_id bigint, row_key bigint, paragraph bigint, start bigint, end bigint, words bigint, n bigint, s1 bigint, s2 bigint, parity bigint"
    found = base.mapInArrow(_paragraphs(percent, n), schema + "".join(f", key{i} bigint" for i in range(bands)))
    # The paragraphs of a text have ids in a row.
    found = scratch.save(found.withColumn("id", F.monotonically_increasing_id()), "paragraphs")

    def fragments(ids: DataFrame) -> DataFrame:
        # Rows that are copies of each other in doc_id, too, are read once.
        wanted = found.join(ids, "id").groupBy("row_key").agg(F.collect_list(F.struct("id", "start", "end")).alias("wanted"))
        once = base.select("row_key", "text").join(wanted, "row_key").groupBy("row_key", "wanted").agg(F.first("text").alias("text"))
        cut = once.select("text", "wanted").mapInArrow(_parts(n), "id bigint, items array<bigint>")
        return cut.select("id", F.lit(0).alias("part"), "items")

    slices = [found.select("id", F.col(f"key{i}").alias("key"), F.lit(True).alias("chosen")) for i in range(bands)]
    meta = found.select("id", "n", F.struct("s1", "s2").alias("sig"), F.array("parity").alias("sketch"))
    labels = linked(slices, meta, fragments, percent, scratch)
    placed = found.select("id", "doc_id", "paragraph", "start", "end", "words").join(labels.withColumnRenamed("node", "id"), "id")
    placed = scratch.save(placed, "clusters")
    scratch.drop(found)
    first = placed.groupBy("component").agg(F.min(F.struct("doc_id", "paragraph", "id")).alias("first"))
    # Neighbours have paragraph numbers in a row; id - paragraph is the same for all of a text.
    text = (F.col("id") - F.col("paragraph")).alias("row")
    near = F.col("paragraph") - F.row_number().over(Window.partitionBy("row").orderBy("paragraph"))
    out = placed.select("*", text).withColumn("stretch", near)
    out = out.withColumn("all", F.sum("words").over(Window.partitionBy("row", "stretch"))).where(F.col("all") >= least_words)
    out = out.join(first, "component")
    return out.select(
        "doc_id", "paragraph", "start", "end", F.col("first.doc_id").alias("first_doc_id"),
        F.col("first.paragraph").alias("first_paragraph"), (F.col("id") != F.col("first.id")).alias("removed"),
    )
