"""Operator 2: token counts by a map-side two-tier lookup.

Tier one is a compact table of the lengths of frequent pre-tokens, broadcast once; tier two encodes
what it lacks and keeps the lengths in a bounded cache of the worker. No pre-token is shuffled: the only
rows exchanged are bounded summaries (heavy hitters) of the partitions.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import column, narrow, pieces

#: Pre-tokens in the broadcast table, and in the summary of one partition.
FREQUENT = 32_768
SUMMARY = 4_096
#: Longest pre-token (characters) that is summarised or cached; with FREQUENT it bounds the broadcast.
LONGEST = 48
#: Lengths a worker keeps of its misses.
MISSES = 1 << 18

# A piece of the vocabulary never holds a space after another character, nor a line feed, so a merge
# never crosses the start of a run of spaces or a line feed, and the counts of these parts add up.
_PARTS = re.compile(r" *[^ \n]+| +|\n")
# Texts with other characters (ones a normaliser may rewrite, or the space mark itself) go whole to the library.
_UNUSUAL = re.compile("[^\n\x20-\x7e¡-§©«¬®°±¶»¿-ıĴ-ľŁ-ňŊ-žƀ-ǃǍ-ǰǴ-ɏ]")

_MODELS: dict[str, Model] = {}


class Model:
    """The library's processor and counts of single pre-tokens."""

    def __init__(self, path: str):
        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.feed = len(self.library.encode("\n"))
        size = self.library.get_piece_size()
        vocabulary = [self.library.id_to_piece(i) for i in range(size)]
        splits = self.library.encode("a  b", out_type=str) == ["▁a", "▁▁", "b"] or "".join(
            self.library.encode("a  b", out_type=str)
        ) == "▁a▁▁b"
        self.additive = splits and not any(re.search("[^▁]▁|\n", p) for p in vocabulary)

    def part(self, part: str) -> int:
        """Tokens of a pre-token: a leading space stands for the mark that the library puts first."""
        if part[0] == " ":
            return len(self.library.encode(part[1:])) if len(part) > 1 else 1
        return len(self.library.encode("\n" + part)) - self.feed

    def whole(self, text: str) -> int:
        return len(self.library.encode(text))


def model(path: str) -> Model:
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def parts(text: str) -> list[str]:
    return _PARTS.findall(" " + text)


class Misses(dict):
    def __init__(self, library: Model):
        super().__init__()
        self.library = library

    def __missing__(self, part: str) -> int:
        count = self.library.part(part)
        if len(part) <= LONGEST:
            if len(self) >= MISSES:
                self.clear()
            self[part] = count
        return count


class Lengths(dict):
    """The frequent tier; misses go to the worker's cache."""

    def __init__(self, table: tuple[bytes, bytes], library: Model):
        blob, lengths = table
        names = blob.decode().split("\0") if blob else []
        super().__init__(zip(names, np.frombuffer(lengths, "<u2").tolist(), strict=True))
        self.misses = Misses(library)

    def __missing__(self, part: str) -> int:
        return self.misses[part]


_LENGTHS: dict[tuple, Lengths] = {}


def _summaries(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in pieces(batches):
            for text in column(batch, "text"):
                if text and not _UNUSUAL.search(text):
                    seen.update(parts(text))
            if len(seen) > 32 * SUMMARY:
                seen = Counter(dict(seen.most_common(8 * SUMMARY)))
        top = [(p, c) for p, c in seen.most_common(2 * SUMMARY) if len(p) <= LONGEST][:SUMMARY]
        yield pa.RecordBatch.from_arrays(
            [pa.array([p for p, _ in top], pa.string()), pa.array([c for _, c in top], pa.int64())], ["part", "seen"]
        )

    return run


def frequent_lengths(docs: DataFrame, path: str) -> tuple[bytes, bytes]:
    """The frequent tier of docs(text): names joined by NUL, and their lengths as 16-bit numbers."""
    summary = docs.select("text").mapInArrow(_summaries(path), "part string, seen bigint")
    total = summary.groupBy("part").agg(F.sum("seen").alias("seen"))
    top = [r.part for r in total.orderBy(F.desc("seen"), "part").limit(FREQUENT).collect()]
    library = model(path)
    return "\0".join(top).encode(), np.array([library.part(p) for p in top], "<u2").tobytes()


def _counted(path: str, table: Broadcast):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        library = model(path)
        key = (path, hash(table.value[0]))
        if key not in _LENGTHS:
            _LENGTHS.clear()
            _LENGTHS[key] = Lengths(table.value, library)
        length = _LENGTHS[key].__getitem__
        for batch in pieces(batches):
            counts = []
            for text in column(batch, "text"):
                if not text:
                    counts.append(0)
                elif library.additive and not _UNUSUAL.search(text):
                    counts.append(sum(map(length, parts(text))))
                else:
                    counts.append(library.whole(text))
            kept = [batch.column(0), batch.column(1), pa.array(counts, pa.int64())]
            yield pa.RecordBatch.from_arrays(kept, ["doc_id", "n_bytes", "n_tokens"])

    return run


def token_counts(docs: DataFrame, path: str, limit: int = 4096) -> DataFrame:
    """One row per row of docs: (doc_id, n_bytes, n_tokens, over_limit), for the whole text.

    A null text counts as empty (0 bytes, 0 tokens); rows that repeat are counted each; a null doc_id
    stays null; other columns are ignored. An empty table gives an empty result.
    """
    base = narrow(docs, "doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(base, path))
    rows = base.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("bigint").alias("n_bytes"), "text")
    counted = rows.mapInArrow(_counted(path, table), "doc_id bigint, n_bytes bigint, n_tokens bigint")
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
