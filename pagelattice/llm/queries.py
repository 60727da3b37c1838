"""One query for each corpus operator, over its whole table, and the SQL where SQL can express it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import documents
from .decontamination import contamination
from .neighbours import nearest_neighbours
from .ngram_join import ngram_jaccard_components
from .packing import best_fit_packing
from .paragraphs import repeated_paragraphs
from .quality import quality_scores
from .repeats import remove_repeats
from .secret_scan import secret_digest
from .sharding import sharded
from .token_counts import token_counts


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op4_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return nearest_neighbours(vectors, queries=F.col("vec_id") % 50 == 0)


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing(documents(spark, sf_dir), tokenizer_path("byte_bpe_50k.json"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_components(documents(spark, sf_dir), n=3, percent=90)


def op7_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the digest: whether anything was removed, and what remains (a character cut in two becomes U+FFFD)."""
    found = remove_repeats(documents(spark, sf_dir), length=400, with_kept=True)
    return found.select(
        "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", (F.col("n_removed") > 0).alias("removed"),
        F.make_valid_utf8(F.col("kept").cast("string")).alias("text"),
    )


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_digest(documents(spark, sf_dir))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the newest manifest holds, read back from its shards."""
    kept = sharded(documents(spark, sf_dir)).read()
    return kept.select(
        "doc_id", "lang", "source", F.octet_length("text").cast("bigint").alias("n_bytes"), F.md5("text").alias("text_md5")
    )


def op10_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_paragraphs(documents(spark, sf_dir))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_quality": op3_quality,
    "op4_neighbours": op4_neighbours,
    "op5_packing": op5_packing,
    "op6_ngram_jaccard": op6_ngram_jaccard,
    "op7_repeats": op7_repeats,
    "op8_secret_scan": op8_secret_scan,
    "op9_sharding": op9_sharding,
    "op10_paragraphs": op10_paragraphs,
}

ORACLE_SQL: dict[str, str] = {
    "op9_sharding": """
        SELECT doc_id, lang, source, CAST(strlen(text) AS BIGINT) AS n_bytes, md5(text) AS text_md5
        FROM documents
    """,
}
