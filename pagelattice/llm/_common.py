"""Shared plumbing of the corpus operators: scratch tables, worker caches and 64-bit hashing."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Seconds between two collections of the driver's garbage, at least.
SWEEP = 2.0
_LAST_SWEEP = [0.0]
_LOCAL_ROOTS: dict[str, str] = {}
_GOLDEN = np.uint64(0x9E3779B97F4A7C15)
_M1 = np.uint64(0xBF58476D1CE4E5B9)
_M2 = np.uint64(0x94D049BB133111EB)


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names; a folder of our own only where none is set."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if named:
        return named.rstrip("/")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL_ROOTS:
        if spark.sparkContext.master.startswith("local["):
            folder = tempfile.mkdtemp(prefix="pagelattice-")
            atexit.register(shutil.rmtree, folder, ignore_errors=True)
            _LOCAL_ROOTS[app] = f"file://{folder}"
        else:
            _LOCAL_ROOTS[app] = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_scratch"
    return _LOCAL_ROOTS[app]


class Scratch:
    """Tables written to the shared folder to cut lineage; an operator drops those it no longer reads."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.base = f"{scratch_root(spark)}/pagelattice/{name}-{uuid.uuid4().hex}"
        self.count = 0

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """Write, and read back with the known schema (no footer pass)."""
        self.count += 1
        path = f"{self.base}/{self.count:03d}-{name}"
        df.write.option("compression", "zstd").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._pagelattice_path = path  # noqa: SLF001
        # Shuffle files of the finished stages go once the driver's JVM has dropped their plans; without a word
        # they stay until its heap is full, which may take longer than the whole job.
        if time.monotonic() - _LAST_SWEEP[0] > SWEEP:
            self.spark.sparkContext._jvm.System.gc()  # noqa: SLF001
            _LAST_SWEEP[0] = time.monotonic()
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_pagelattice_path", None)
            if path:
                delete(self.spark, path)


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm  # noqa: SLF001
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)  # noqa: SLF001


def is_empty(df: DataFrame) -> bool:
    return not df.take(1)


def mix(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser, over an array of uint64."""
    with np.errstate(over="ignore"):
        x = x + _GOLDEN
        x = (x ^ (x >> np.uint64(30))) * _M1
        x = (x ^ (x >> np.uint64(27))) * _M2
        return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """A worker's cache of word hashes, emptied when it reaches its bound."""

    BOUND = 1 << 20

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.BOUND:
            self.clear()
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value


_WORDS = WordHashes()
_ASCII_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


_BASE = 0x9E3779B97F4A7C15
#: A random number for each byte, for polynomial hashes modulo 2^64.
BYTE_CODES = mix(np.arange(256, dtype=np.uint64) + np.uint64(77))
_SPACES = np.isin(np.arange(256), [32, *range(9, 14)])
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
#: Bytes whose words are hashed at once.
_AT_ONCE = 1 << 20


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """n powers at least of the base and of its inverse modulo 2^64, kept by size."""
    size = 1 << max(10, n - 1).bit_length()
    if size not in _POWERS:
        up, down = np.full(size, _BASE, np.uint64), np.full(size, pow(_BASE, -1, 1 << 64), np.uint64)
        up[0] = down[0] = 1
        _POWERS[size] = np.multiply.accumulate(up), np.multiply.accumulate(down)
    return _POWERS[size]


def prefix_sums(data: bytes) -> np.ndarray:
    """sums[j] - sums[i], times the inverse power of i, is the polynomial hash of data[i:j]."""
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_CODES[np.frombuffer(data, np.uint8)] * powers(len(data) + 1)[0][: len(data)], out=sums[1:])
    return sums


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, starts) of the words between ASCII white space, with A-Z lower-cased."""
    hashes, starts, at = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], 0
    while at < len(data):
        end = len(data)
        if end - at > _AT_ONCE:
            cut = re.compile(rb"[ \t-\r]").search(data, at + _AT_ONCE)
            end = cut.start() if cut else end
        part = data[at:end].translate(_ASCII_LOWER)
        space = _SPACES[np.frombuffer(part, np.uint8)]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], space, [True])).view(np.int8)))
        first, last = edge[::2], edge[1::2]
        sums, down = prefix_sums(part), powers(len(part) + 1)[1]
        hashes.append(mix((sums[last] - sums[first]) * down[first]))
        starts.append(first + at)
        at = end
    return np.concatenate(hashes), np.concatenate(starts)


def word_ids(text: str | None) -> np.ndarray:
    return word_hashes(utf8(text))[0]


def hash_words(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_WORDS.__getitem__, words), np.uint64, len(words))


def ngram_hashes(ids: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n word hashes, in order; empty if there are fewer than n."""
    m = len(ids) - n + 1
    if m <= 0:
        return np.empty(0, np.uint64)
    out = mix(ids[:m])
    with np.errstate(over="ignore"):
        for j in range(1, n):
            out = mix(out * _M1 + ids[j : j + m])
    return out


def shingle_set(ids: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct n-word shingles of word hashes; a shorter sequence is one shingle, none has none."""
    if not len(ids):
        return np.empty(0, np.uint64)
    if len(ids) < n:
        return mix(ngram_hashes(ids, len(ids)) ^ np.uint64(len(ids)))
    grams = ngram_hashes(ids, n)
    grams.sort()
    return grams[np.concatenate(([True], grams[1:] != grams[:-1]))]


def parity_sketch(items: np.ndarray) -> np.ndarray:
    """Per bucket of hashes whether an odd number falls in it, 64 buckets a word: about a bit for each item.

    Two sketches differ in no more bits than the sets in items, and halving one (its halves combined by
    exclusive or) gives the sketch of that length.
    """
    words = max(4, 1 << (max(1, len(items)) - 1).bit_length() >> 6)
    odd = np.bincount((items % np.uint64(64 * words)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view(np.uint64)


def long_lists(arrays: list[np.ndarray]) -> pa.Array:
    """uint64 arrays as list<int64>, without a Python object for each element."""
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.empty(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))


def column(batch: pa.RecordBatch, name: str) -> list:
    return batch.column(batch.schema.get_field_index(name)).to_pylist()


#: Bytes of a piece's texts and other columns, unless one row alone has more.
PIECE_BYTES = 4 << 20


def _trimmer():
    """glibc's malloc_trim, where there is one."""
    try:
        return ctypes.CDLL(None).malloc_trim
    except (OSError, AttributeError):
        return lambda pad: 0


_TRIM = _trimmer()


def released() -> None:
    """Give back what the allocators of this worker hold without need: idle workers stay, and count in their executor's memory."""
    pa.default_memory_pool().release_unused()
    _TRIM(0)


def _cut(batch: pa.RecordBatch, rows: int) -> Iterator[pa.RecordBatch]:
    """Stretches of at most so many rows, halved while they have more than PIECE_BYTES."""
    if batch.num_rows > rows:
        for at in range(0, batch.num_rows, rows):
            yield from _cut(batch.slice(at, rows), rows)
    elif batch.num_rows > 1 and batch.nbytes > PIECE_BYTES:
        half = batch.num_rows // 2
        yield from _cut(batch.slice(0, half), rows)
        yield from _cut(batch.slice(half), rows)
    elif batch.num_rows:
        yield batch


def pieces(batches: Iterable[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Smaller batches, so that what a worker holds at once stays small with long texts, and is given back after each batch."""
    for batch in batches:
        yield from _cut(batch, rows)
        batch = None  # noqa: PLW2901
        released()


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def narrow(docs: DataFrame, *names: str) -> DataFrame:
    """Only the named columns, under types that do not depend on the file."""
    kinds = {"doc_id": "bigint", "item_id": "bigint", "vec_id": "bigint", "text": "string"}
    return docs.select(*[F.col(n).cast(kinds[n]).alias(n) if n in kinds else F.col(n) for n in names])
