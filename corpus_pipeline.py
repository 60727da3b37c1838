"""A pipeline over documents that chains five of the corpus operators.

Each stage takes (spark, docs, sf_dir), works on all rows that the one before it kept, and returns the
columns of documents; the last returns packed pieces. run() writes every stage as Parquet in the shared
folder and reads it again for the next.

Null and empty texts: an empty text is scored by its statistics like any other, links with nothing, holds no
benchmark item and no secret, and is packed as one end mark; so is a null text, which stays null until it is
packed. Rows without a doc_id are never removed by an id. Rows that repeat a doc_id go or stay together. Columns
besides doc_id and text, whatever their names, pass through every stage but the last; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagelattice.llm._common import Scratch, documents
from pagelattice.llm.decontamination import contamination
from pagelattice.llm.ngram_join import ngram_jaccard_components
from pagelattice.llm.packing import best_fit_packing
from pagelattice.llm.quality import quality_scores
from pagelattice.llm.queries import tokenizer_path
from pagelattice.llm.secret_scan import scan_secrets


def _without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """docs but for those ids; rows without an id stay."""
    return docs.join(ids.distinct(), "doc_id", "left_anti").select(*docs.columns)


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return _without(docs, quality_scores(docs, labels).where("predicted = 0").select("doc_id"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a Jaccard similarity of 0.8 over five-word shingles the smallest id stays."""
    found = ngram_jaccard_components(docs, n=5, percent=80)
    return _without(docs, found.where("component_id <> doc_id").select("doc_id"))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return _without(docs, contamination(docs, benchmark).select("doc_id"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark in the texts; no document goes."""
    return scan_secrets(docs, keep=[c for c in docs.columns if c not in ("doc_id", "text", "n_chars")]).select(
        *[
            F.col("redacted_text").alias("text")
            if c == "text"
            else F.coalesce(F.char_length("redacted_text"), F.lit(0)).cast(docs.schema[c].dataType).alias(c)
            if c == "n_chars"
            else F.col(c)
            for c in docs.columns
        ]
    )


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, cut and packed into sequences of 1024 tokens."""
    return best_fit_packing(docs, tokenizer_path("byte_bpe_50k.json"))


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("benchmark decontamination", decontaminated),
    ("secret scans", without_secrets),
    ("best-fit packing", packed),
]

#: No stage but set logic could be put in SQL; tests hold every stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    scratch = Scratch(spark, "pipeline")
    docs = documents(spark, sf_dir)
    for name, stage in STAGES:
        after = scratch.save(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        scratch.drop(docs)
        docs = after
    return docs
