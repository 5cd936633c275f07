"""From documents to a searchable collection as one lazy lineage."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.vectors import checked_dim, length_embedding
from bidlake.operators.chunking import MAX_TOKENS, OVERLAP_TOKENS, document_chunks
from bidlake.operators.relational import upsert
from bidlake.operators.vector_search import vector_topk_many

Embedder = Callable[[Column], Column]


def default_embedder(dim: int) -> Embedder:
    return lambda text: length_embedding(text, dim).cast("array<float>")


def collection_rows(chunks: DataFrame, dim: int, embed: Embedder | None = None) -> DataFrame:
    """Chunks in the stored shape with their vectors; a vector of another width fails the job.

    ``embed`` maps a text column to a vector column: a built-in expression or a pandas UDF that
    calls a model once per Arrow batch.
    """
    embed = embed or default_embedder(dim)
    tender = F.col("tender_id") if "tender_id" in chunks.columns else F.col("document_id").cast("string")
    return chunks.select(
        "id", "text", "section_path", tender.alias("tender_id"), "metadata", "page_numbers", "source_chunk_id",
        checked_dim(embed(F.col("text")), dim).alias("embedding"))


def ingest_blocks(documents: DataFrame, id_column: str, dim: int, embed: Embedder | None = None,
                  size: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS, min_tokens: int | None = None) -> DataFrame:
    """Documents with a ``blocks`` array to collection rows; ``min_tokens`` as in ``document_chunks``."""
    return collection_rows(document_chunks(documents, id_column, size, overlap, min_tokens), dim, embed)


def upsert_chunks(collection: DataFrame, rows: DataFrame, order: str = "ord") -> DataFrame:
    return upsert(collection, rows, "id", order)


def self_check(rows: DataFrame, collection: DataFrame, document_column: str, id_column: str = "id",
               vector_column: str = "embedding", k: int = 1) -> DataFrame:
    """Search the collection with the first chunk of every document: (query_id, id, score, rank).

    No chunks give no rows."""
    first = rows.groupBy(document_column).agg(F.min_by(F.struct(id_column, vector_column), id_column).alias("f"))
    queries = first.select(F.col(f"f.{id_column}").alias("qid"), F.col(f"f.{vector_column}").alias("query_vector"))
    return vector_topk_many(queries, collection, k, id_column=id_column, vector_column=vector_column)
