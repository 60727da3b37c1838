"""Operator 5: best-fit packing planned over a histogram of lengths.

Best fit runs on the driver over the counts of the lengths (at most `capacity` of them), never over
documents: bins of equal content form contiguous ranges of sequence numbers. Documents then take the
planned slots by their rank within their length.
"""

from __future__ import annotations

import re
import sys
import unicodedata
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import islice
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ._common import Scratch, column, narrow, pieces

#: Pre-tokens whose ids a worker keeps; the older half goes when it is full.
CACHED = 1 << 20


def _class(kind: str) -> str:
    return "".join(re.escape(chr(i)) for i in range(0x250) if unicodedata.category(chr(i))[0] == kind)


# The byte-level pre-tokeniser's published pattern over the characters below U+0250; any other text, and
# texts with the special token's string, go whole to the library.
_LETTER, _NUMBER = _class("L"), _class("N")
_SPLIT = re.compile(
    f" ?[{_LETTER}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_NUMBER}]+| ?[^ \\t\\n\\r{_LETTER}{_NUMBER}]+"
    "|[ \\t\\n\\r]+(?![^ \\t\\n\\r])|[ \\t\\n\\r]+"
)
_UNUSUAL = re.compile("[^\t\n\r\x20-\x7e¡-ɏ]")
_TOKENIZERS: dict[str, Ids] = {}


def _byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for characters from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


_ALPHABET = _byte_alphabet()


class Ids(dict):
    """A worker's cache: pre-token to its ids as little-endian 32-bit bytes."""

    def __init__(self, path: str):
        super().__init__()
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.model = self.library.model
        self.special = [t.content for t in self.library.get_added_tokens_decoder().values()]

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def __missing__(self, part: str) -> bytes:
        """Ids of one pre-token, from the library's model alone."""
        ids = array("I", [t.id for t in self.model.tokenize(part.encode().decode("latin-1").translate(_ALPHABET))])
        if sys.byteorder == "big":
            ids.byteswap()
        data = ids.tobytes()
        if len(part) <= 48:
            if len(self) >= CACHED:
                for old in list(islice(self, CACHED // 2)):
                    del self[old]
            self[part] = data
        return data

    def of(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _UNUSUAL.search(text) or any(s in text for s in self.special):
            return self.whole(text)
        return b"".join(map(self.__getitem__, _SPLIT.findall(text)))


def tokenizer(path: str) -> Ids:
    if path not in _TOKENIZERS:
        _TOKENIZERS[path] = Ids(path)
    return _TOKENIZERS[path]


def _cut(path: str, capacity: int, end: int, with_ids: bool):
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids
    last = np.array([end], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = tokenizer(path)
        for batch in pieces(batches):
            rows = []
            for doc, text in zip(column(batch, "doc_id"), column(batch, "text"), strict=True):
                data = ids.of(text) + last
                n = len(data) // 4
                first = (n - 1) % capacity + 1
                at = [0, *range(first, n + 1, capacity)]
                for k in range(len(at) - 1):
                    part = data[4 * at[k] : 4 * at[k + 1]]
                    rows.append((doc, k, at[k], at[k + 1] - at[k], zlib.crc32(part), part))
            cols = list(zip(*rows, strict=True)) if rows else [()] * 6
            kinds = [pa.int64()] * 5 + [pa.binary()]
            arrays = [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)][: len(names)]
            yield pa.RecordBatch.from_arrays(arrays, names)

    return run


def plan(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best fit, longest first, over counts of lengths.

    Rows (length, first_rank, last_rank, first_bin, per_bin, offset): ranks of that length fill the
    bins from first_bin on, per_bin in each, from offset on. Free bins are kept as ranges of equal room.
    """
    placed: list[tuple[int, int, int, int, int, int]] = []
    rooms: list[int] = []  # sorted
    ranges: dict[int, list[tuple[int, int]]] = {}
    bins = 0

    def free(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in ranges:
                insort(rooms, room)
                ranges[room] = []
            held = ranges[room]
            if held and held[-1][0] + held[-1][1] == first:
                held[-1] = (held[-1][0], held[-1][1] + n)
            else:
                held.append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                first, n = ranges[room].pop()
                if not ranges[room]:
                    del ranges[room]
                    rooms.pop(at)
            else:
                room, first = capacity, bins
                n = -(-left // (capacity // length))
                bins += n
            each = room // length
            full = min(n, left // each)
            if full:
                placed.append((length, rank, rank + full * each - 1, first, each, capacity - room))
                rank, left = rank + full * each, left - full * each
                free(room - each * length, first, full)
            if left and full < n:
                placed.append((length, rank, rank + left - 1, first + full, left, capacity - room))
                free(room - left * length, first + full, 1)
                full, left = full + 1, 0
            if full < n:
                free(room, first + full, n - full)
    return placed


def best_fit_packing(
    docs: DataFrame, path: str, capacity: int = 1024, end: int = 2, with_ids: bool = False
) -> DataFrame:
    """Pack documents into sequences of at most `capacity` tokens, one row per piece.

    (doc_id, piece, start, length, ids_crc32, sequence_id, offset), with the ids as little-endian 32-bit
    bytes if asked for. A document is its ids and `end`; only longer ones are cut, the first piece taking
    the remainder. A null text is empty (one token); repeated rows are packed each; a null doc_id stays
    null; other columns are ignored; an empty table gives no rows. Ties within a length go by doc_id.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    kinds = "doc_id bigint, piece bigint, start bigint, length bigint, ids_crc32 bigint" + ", ids binary" * with_ids
    cut = narrow(docs, "doc_id", "text").mapInArrow(_cut(path, capacity, end, with_ids), kinds)
    cut = scratch.save(cut, "pieces")
    histogram = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}
    slots = spark.createDataFrame(
        plan(histogram, capacity),
        "slot_length bigint, first_rank bigint, last_rank bigint, first_bin bigint, per_bin bigint, base bigint",
    )
    # Rank within a length, without one task per length: rank inside a bucket, plus the rows of the
    # buckets before it. About the square root of all rows makes both parts small.
    spread = max(1, isqrt(sum(histogram.values())))
    cut = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(spread)))
    sizes = cut.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("length", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skip"))
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32")
    ranked = cut.withColumn("row", F.row_number().over(inside) - 1).join(sizes, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("row") + F.col("skip"))
    met = ranked.join(
        F.broadcast(slots),  # a few rows for each of at most `capacity` lengths, whatever the input
        (F.col("length") == F.col("slot_length")) & F.col("rank").between(F.col("first_rank"), F.col("last_rank")),
    )
    nth = F.col("rank") - F.col("first_rank")
    bin_of = (F.col("first_bin") + F.floor(nth / F.col("per_bin"))).cast("bigint")
    return met.select(
        "doc_id", F.col("piece").cast("int").alias("piece"), "start", "length", "ids_crc32", *["ids"] * with_ids,
        bin_of.alias("sequence_id"),
        (F.col("base") + (nth % F.col("per_bin")) * F.col("length")).cast("bigint").alias("offset"),
    )
