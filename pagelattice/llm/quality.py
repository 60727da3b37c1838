"""Operator 3: a quality classifier by regularised quadratic discriminant analysis.

Statistics of a text are transformed to be roughly Gaussian; each class has its mean and a covariance
shrunk towards its diagonal; a score is the posterior from the difference of the log-densities, with
Mahalanobis distances by Cholesky factors that are computed once.
"""

from __future__ import annotations

from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ._common import Scratch, column, long_lists, narrow, pieces, utf8

#: Weight of the diagonal in a shrunk covariance, and what is added to each variance.
SHRINKAGE = 0.05
RIDGE = 1e-3
#: Added to what shares are taken of, so that a few words do not look extreme.
PRIOR = 20
FEATURES = 13

_BYTES = np.arange(256)
_UPPER = (_BYTES >= 65) & (_BYTES <= 90)
_LOWER = (_BYTES >= 97) & (_BYTES <= 122)
_DIGIT = (_BYTES >= 48) & (_BYTES <= 57)
_POINT = np.isin(_BYTES, list(b".,;:?'\"()-"))
_SYMBOL = np.isin(_BYTES, list(b"#$%&*|@^~<>{}[]=+_/\\"))
_GROUPS = np.stack([_UPPER, _LOWER, _DIGIT, _POINT, _SYMBOL, _BYTES == 33, _BYTES == 10, _BYTES >= 128]).astype(float)


def statistics(text: str | None) -> np.ndarray:
    """Transformed statistics of a whole text; a null text is empty."""
    data = utf8(text)
    n = len(data)
    upper, lower, digit, point, symbol, shout, feed, high = _GROUPS @ np.bincount(np.frombuffer(data, np.uint8), minlength=256)
    words = data.split()
    w = len(words)
    repeats = sum(map(eq, words, words[1:])) if w > 1 else 0
    share = lambda k, of: np.sqrt((k + 0.01) / (of + PRIOR))
    return np.array([
        np.log(n + PRIOR), np.log((len(set(words)) + PRIOR) / (w + PRIOR)), share(repeats, w), share(upper, upper + lower),
        share(lower, n), share(digit, n), share(point, n), share(symbol, n), share(shout, n), share(feed, n),
        share(high, n), np.log((n + 6 * PRIOR) / (w + PRIOR)), np.log(w + PRIOR),
    ])


def _measured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in pieces(batches):
        rows = [statistics(t).view(np.uint64) for t in column(batch, "text")]
        lists = long_lists(rows)
        values = pa.ListArray.from_arrays(lists.offsets, pa.Array.from_buffers(pa.float64(), len(lists.values), lists.values.buffers()))
        yield pa.RecordBatch.from_arrays([batch.column(0), values], ["doc_id", "x"])


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a class and partition: count, sums and sums of products."""
    sums = {0: np.zeros((FEATURES + 1, FEATURES + 1)), 1: np.zeros((FEATURES + 1, FEATURES + 1))}
    for batch in batches:
        label = np.array(column(batch, "label"), int)
        x = np.array(column(batch, "x"), float).reshape(len(label), FEATURES)
        x = np.hstack([np.ones((len(x), 1)), x])
        for k in sums:
            sums[k] += x[label == k].T @ x[label == k]
    used = [k for k in sums if sums[k][0, 0]]
    yield pa.RecordBatch.from_arrays(
        [pa.array(used, pa.int32()), pa.array([sums[k].ravel().tolist() for k in used], pa.list_(pa.float64()))],
        ["label", "m"],
    )


class Discriminant:
    """Two Gaussians; score() gives the posterior of class 1."""

    def __init__(self, moments: dict[int, np.ndarray]):
        self.n = {k: float(m[0, 0]) for k, m in moments.items()}
        total = sum(moments.values()) if moments else None
        self.parts = {}
        if len(moments) == 2:
            centre = total[0, 1:] / total[0, 0]
            spread = np.sqrt(np.maximum(np.diag(total)[1:] / total[0, 0] - centre**2, 0)) + 1e-6
            for k, m in moments.items():
                mean = (m[0, 1:] / m[0, 0] - centre) / spread
                second = (m[1:, 1:] - np.outer(m[0, 1:], centre) - np.outer(centre, m[0, 1:])) / m[0, 0] + np.outer(centre, centre)
                cov = second / np.outer(spread, spread) - np.outer(mean, mean)
                cov = (1 - SHRINKAGE) * cov + SHRINKAGE * np.diag(np.diag(cov)) + RIDGE * np.eye(len(mean))
                factor = np.linalg.cholesky(cov)
                self.parts[k] = (mean, np.linalg.inv(factor), 2 * np.log(np.diag(factor)).sum() - 2 * np.log(m[0, 0] / total[0, 0]))
            self.centre, self.spread = centre, spread

    def score(self, x: np.ndarray) -> np.ndarray:
        if not self.parts:  # labels of one class, or none
            return np.full(len(x), 1.0 if self.n.get(1) else 0.0 if self.n.get(0) else 0.5)
        z = (x - self.centre) / self.spread
        density = {k: -0.5 * ((((z - mean) @ back.T) ** 2).sum(1) + bias) for k, (mean, back, bias) in self.parts.items()}
        return 1 / (1 + np.exp(-np.clip(density[1] - density[0], -500, 500)))


def measured(docs: DataFrame) -> DataFrame:
    """(doc_id, x) with the statistics of every whole text."""
    return narrow(docs, "doc_id", "text").mapInArrow(_measured, "doc_id bigint, x array<double>")


def held_out() -> F.Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 5 == 0, F.lit(False))


def fit(features: DataFrame, labels: DataFrame) -> Discriminant:
    """From all labelled rows that are not held out; a doc_id with contradictory labels is not used."""
    known = labels.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("quality").cast("int").alias("label"))
    known = known.where("label in (0, 1) and doc_id is not null").groupBy("doc_id")
    known = known.agg(F.min("label").alias("label"), F.max("label").alias("most")).where("label = most")
    rows = features.where(~held_out()).join(known.select("doc_id", "label"), "doc_id").select("label", "x")
    partial = rows.mapInArrow(_moments, "label int, m array<double>")
    side = FEATURES + 1
    total = partial.groupBy("label").agg(*[F.sum(F.col("m")[i]).alias(f"m{i}") for i in range(side * side)])
    return Discriminant({r[0]: np.array(r[1:], float).reshape(side, side) for r in total.collect()})


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """One row per row of docs: (doc_id, held_out, score, predicted).

    A null text is scored as an empty one. Labels other than 0 and 1, null ids and contradictory labels
    are not learned from; with labels of one class only, every score is that class, with none 0.5. Rows
    whose doc_id is null are scored, and are not held out. Other columns are never read.
    """
    scratch = Scratch(docs.sparkSession, "quality")
    features = scratch.save(measured(docs), "features")
    model = fit(features, labels)

    @F.pandas_udf(DoubleType())
    def score(x: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(x.to_numpy())) if len(x) else np.empty(0))

    scored = features.select("doc_id", held_out().alias("held_out"), score("x").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))
