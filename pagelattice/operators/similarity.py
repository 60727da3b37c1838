"""Similarity of all pairs of texts that share a key: shared words are counted by matrix products over blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: A key's texts are dealt out to so many blocks that one has about so many texts, and bytes, at most.
BLOCK_TEXTS = 1024
BLOCK_BYTES = 4 << 20
#: A word is counted by a matrix product if it makes more pairs than one in so many, else pair by pair.
DENSE = 200
#: Columns of a matrix, pairs of a rare word and rows of a result that are held at once.
COLUMNS = 1024
AT_ONCE = 1 << 20
ROWS = 1 << 16


def _distinct(texts: list[str], vocabulary: dict[str, int]) -> tuple[np.ndarray, np.ndarray]:
    """(text, word) of every distinct word of every text, by number."""
    sets = [{vocabulary.setdefault(w, len(vocabulary)) for w in t.split(" ")} for t in texts]
    sizes = [len(s) for s in sets]
    return np.repeat(np.arange(len(texts)), sizes), np.fromiter((w for s in sets for w in s), np.int64, sum(sizes))


def shared_words(one: list[str], two: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """How many distinct words each text of one shares with each of two, and how many each text has."""
    vocabulary: dict[str, int] = {}
    (ta, wa), (tb, wb) = _distinct(one, vocabulary), _distinct(two, vocabulary)
    na, nb = len(one), len(two)
    sa, sb = np.bincount(ta, minlength=na), np.bincount(tb, minlength=nb)
    fa, fb = np.bincount(wa, minlength=len(vocabulary)), np.bincount(wb, minlength=len(vocabulary))
    common = np.zeros((na, nb), np.float32)
    dense = np.flatnonzero(fa * fb * DENSE > na * nb) if na * nb > DENSE else np.empty(0, np.int64)
    for at in range(0, len(dense), COLUMNS):
        some = dense[at : at + COLUMNS]
        place = np.full(len(vocabulary), -1)
        place[some] = np.arange(len(some))
        sides = []
        for t, w, n in ((ta, wa, na), (tb, wb, nb)):
            mine = place[w] >= 0
            side = np.zeros((n, len(some)), np.float32)
            side[t[mine], place[w[mine]]] = 1
            sides.append(side)
        common += sides[0] @ sides[1].T
    rare = np.ones(len(vocabulary), bool)
    rare[dense] = False
    mine = rare[wa] & (fb[wa] > 0)
    ta, wa = ta[mine], wa[mine]
    order = np.argsort(wb, kind="stable")
    met, first = tb[order], np.cumsum(fb) - fb
    ends = np.cumsum(fb[wa])
    at = 0
    while at < len(ta):
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + AT_ONCE, "right")))
        many = fb[wa[at:to]]
        others = met[np.repeat(first[wa[at:to]], many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
        np.add.at(common.reshape(-1), np.repeat(ta[at:to], many) * nb + others, np.float32(1))
        at = to
    return common, sa, sb


def similarities(one: list[str], two: list[str]) -> np.ndarray:
    """functions.text.line_similarity, to six places, of each distinct text of one with each of two; both by words_only."""
    common, sa, sb = shared_words(one, two)
    la, lb = np.array([len(t) for t in one]), np.array([len(t) for t in two])
    # A text inside another has all its words but the first and last in common with it.
    shorter = la[:, None] < lb, la[:, None] > lb
    least = np.where(shorter[0], sa[:, None], sb) - 2
    inside = np.argwhere((shorter[0] | shorter[1]) & (common >= least))
    out = common / np.maximum(np.maximum(sa[:, None], sb), 1).astype(np.float64)
    for a, b in inside.tolist():
        s, t = one[a], two[b]
        if s in t or t in s:
            out[a, b] = min(len(s), len(t)) / max(len(s), len(t), 1)
    same = {t: b for b, t in enumerate(two)}
    for a, t in enumerate(one):
        if t in same:
            out[a, same[t]] = 1
    out[la == 0], out[:, lb == 0] = 0, 0
    return np.floor(out * 1e6 + 0.5) / 1e6


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows in a row with the same key, i and j."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(n).to_pylist() for n in ("key", "i", "j")), strict=True))
        starts = [k for k in range(len(names)) if not k or names[k] != names[k - 1]]
        for a, b in zip(starts, [*starts[1:], len(names)], strict=True):
            if held and names[a] != last:
                yield pa.Table.from_batches(held)
                held = []
            last = names[a]
            held.append(batch.slice(a, b - a))
    if held:
        yield pa.Table.from_batches(held)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for group in _groups(batches):
        ids, lines, side = (group.column(n) for n in ("id", "line", "side"))
        alone = group.column("i")[0].as_py() == group.column("j")[0].as_py()
        right = side.to_numpy()
        ids, lines = ids.to_numpy(), lines.to_pylist()
        sides = []
        for mine in (np.flatnonzero(~right), np.flatnonzero(right)):
            known: dict[str, int] = {}
            text = np.array([known.setdefault(lines[k], len(known)) for k in mine.tolist()], np.int64)
            sides.append((ids[mine], text, list(known)))
        if alone:
            sides[1] = sides[0]
        (ia, ta, one), (ib, tb, two) = sides
        if not len(ia) or not len(ib):
            continue
        like = similarities(one, two)
        step = max(1, ROWS // len(ib))
        for at in range(0, len(ia), step):
            a, b = np.broadcast_arrays(ia[at : at + step, None], ib)
            # A block meets itself in both orders, two blocks only in one.
            take = a < b if alone else a != b
            values = like[ta[at : at + step, None], tb][take]
            a, b = a[take], b[take]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(values)], ["a", "b", "similarity"])


def similar_pairs(texts: DataFrame) -> DataFrame:
    """(a, b, similarity) of all pairs of rows of texts(id bigint, key, line) with a < b that share a key.

    Similarity is functions.text.line_similarity, rounded to six places; lines are as words_only makes them. A key's rows are
    dealt out to blocks, every two of which meet in a group of their own, so a group's size is bounded, whatever the key's.
    Within a group copies of a line are compared once. Rows without an id or a key pair with nothing.
    """
    texts = texts.where("id is not null and key is not null").select("id", "key", "line")
    # The rows' numbers deal out copies, too.
    texts = texts.withColumn("deal", F.xxhash64("id", F.monotonically_increasing_id()))
    keys = texts.groupBy("key").agg(F.count("*").alias("n"), F.sum(F.length("line")).alias("bytes"))
    blocks = F.ceil(F.greatest(F.col("n") / BLOCK_TEXTS, F.col("bytes") / BLOCK_BYTES, F.lit(1)))
    keys = keys.where("n > 1").select("key", blocks.alias("blocks"))
    rows = texts.join(keys, "key").withColumn("own", F.pmod("deal", "blocks"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("blocks") - 1)))
    rows = rows.select(
        "key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), (F.col("own") > F.col("other")).alias("side"), "id", "line"
    )
    rows = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return rows.mapInArrow(_compared, "a bigint, b bigint, similarity double")
