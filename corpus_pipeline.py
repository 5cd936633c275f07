"""The corpus pipeline: from documents to packed training sequences.

Every stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. Each result
is written to the shared folder and read back as the next stage's documents. All stages but the last
return the columns of ``documents``, whatever further columns it has. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import language, mixing, packing, signature_join, suffixes
from bidlake.llm.common import stage
from bidlake.llm.tokens import vocabulary_path

# Trained models, a tokenizer and shingle components are beyond SQL; tests/llm/test_pipeline.py compares
# join, suffix dedup and packing with brute force, the language stage with its model's own verdict on
# each row, and the mix with the decisions of mixing.mix.
ORACLE_SQL = None


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the language model rejects go."""
    return language.accepted(docs, language.fit(docs))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of near copies one row stays, that of the smallest doc_id; rows without a doc_id stay."""
    return signature_join.one_of_each_group(docs)


def remove_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages that repeat anywhere go; n_chars follows the text that is left. Every row stays."""
    left = suffixes.remove_repeats(docs, texts=True)
    return left.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else left


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows as often as the mix takes them."""
    return mixing.mixed_rows(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row per piece with its place in a sequence."""
    return packing.pack(docs, vocabulary_path())


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("suffix_array_dedup", remove_repeated_passages),
    ("source_mix", mix_sources),
    ("best_fit_packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = spark.read.parquet(f"{sf_dir.rstrip('/')}/documents.parquet")
    for name, function in STAGES[:-1]:
        docs = stage(function(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
