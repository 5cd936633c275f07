"""Combining ranked hit lists, reranking and context under a token budget.

Hit lists hold at most k rows per query, so the windows here run over bounded groups.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.text import first_truthy, token_count

ALPHA = 0.7
MAX_CONTEXT_TOKENS = 2000

Reranker = Callable[[DataFrame, int], DataFrame]


def hybrid_fusion(
    vector_hits: DataFrame, keyword_hits: DataFrame, alpha: float = ALPHA, k: int | None = None, mode: str = "max",
) -> DataFrame:
    """Merge two hit lists with columns (qid, ord, id[, source_chunk_id], score, …) per query.

    A vector hit scores alpha · score / (largest vector score of the query), a keyword hit
    1 − alpha. ``mode="max"`` keeps, per key, the whole row with the larger score (the later row
    only if strictly larger); ``mode="sum"`` adds the two scores and prefers the vector row. The
    key is ``id``, or ``source_chunk_id`` where ``id`` is empty; rows with neither are dropped.
    Ranking is by score, then by first appearance. A largest score of zero gives zero scores; a
    negative one turns the order of the vector side round, as the quotient does.
    """
    if mode not in ("max", "sum"):
        raise ValueError("mode must be 'max' or 'sum'")
    best = F.max("score").over(Window.partitionBy("qid"))
    # a null or zero maximum divides by nothing
    vector = vector_hits.withColumn("_best", F.coalesce(best, F.lit(1.0)))
    share = F.when(F.col("_best") != 0, F.coalesce("score", F.lit(0.0)) / F.nullif("_best", F.lit(0.0))).otherwise(0.0)
    vector = vector.withColumn("score", F.lit(float(alpha)) * share).withColumn("_side", F.lit(0)).drop("_best")
    keyword = keyword_hits.withColumn("score", F.lit(1.0 - float(alpha))).withColumn("_side", F.lit(1))
    both = vector.unionByName(keyword, allowMissingColumns=True)
    key = first_truthy(F.col("id").cast("string"),
                       F.col("source_chunk_id") if "source_chunk_id" in both.columns else F.lit(None).cast("string"))
    both = both.withColumn("_key", key).filter("_key is not null")
    per_key = Window.partitionBy("qid", "_key")
    both = both.withColumn("_first", F.min(F.struct("_side", "ord")).over(per_key))
    if mode == "sum":
        # a list counts once per key, with its best row
        of_list = Window.partitionBy("qid", "_key", "_side").orderBy(F.desc("score"), "ord")
        both = both.withColumn("_nth", F.row_number().over(of_list)).filter("_nth = 1")
        both = both.withColumn("_total", F.sum("score").over(per_key))
        chosen = F.row_number().over(per_key.orderBy("_side"))
        kept = both.withColumn("_nth", chosen).filter("_nth = 1").withColumn("score", F.col("_total"))
        kept = kept.drop("_total")
    else:
        chosen = F.row_number().over(per_key.orderBy(F.desc("score"), "_side", "ord"))
        kept = both.withColumn("_nth", chosen).filter("_nth = 1")
    order = Window.partitionBy("qid").orderBy(F.desc("score"), "_first")
    ranked = kept.withColumn("rank", F.row_number().over(order)).drop("_nth", "_first", "_key", "_side", "ord")
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def best_per_id(hits: DataFrame, k: int | None = None, id_column: str = "id") -> DataFrame:
    """Merge the hits of several query variants of one question: best score per id, ranked."""
    merged = hits.groupBy("qid", id_column).agg(F.max("score").alias("score"), F.count(F.lit(1)).alias("n_variants"))
    order = Window.partitionBy("qid").orderBy(F.desc("score"), id_column)
    ranked = merged.withColumn("rank", F.row_number().over(order))
    return ranked if k is None else ranked.filter(F.col("rank") <= k)


def rerank(hits: DataFrame, k: int, reranker: Reranker | None = None) -> DataFrame:
    """Apply a reranker (a function on the hit DataFrame and k) and cut each query to k rows."""
    result = reranker(hits, k) if reranker else hits
    return result.filter(F.col("rank") <= k)


def rescored(score: Column) -> Reranker:
    """Reranker that ranks by a column expression, ties by the former rank."""
    def apply(hits: DataFrame, k: int) -> DataFrame:
        scored = hits.withColumn("score", score)
        order = Window.partitionBy("qid").orderBy(F.desc_nulls_last("score"), "rank")
        return scored.withColumn("_rank", F.row_number().over(order)).drop("rank").withColumnRenamed("_rank", "rank")
    return apply


def term_overlap(question: str | Column, text: str | Column) -> Column:
    """Share of the question's distinct lower-cased tokens that occur in the text."""
    asked = F.array_distinct(F.split(F.lower(F.trim(question)), " +"))
    found = F.array_intersect(asked, F.split(F.lower(text), "[ \\t\\n\\x0b\\f\\r]+"))
    return F.size(found) / F.greatest(F.size(asked), F.lit(1))


def metadata_boost(
    score: str | Column = "score", publication_date: str | Column = "publication_date",
    base_amount: str | Column = "base_amount", section_type: str | Column = "section_type",
    recent_from: str = "2025-01-01", high_value: float = 1_000_000.0,
) -> Column:
    """score · (1 + 0.1 if recent + 0.05 if high value + 0.15 if a requirements section)."""
    def col(c: str | Column) -> Column:
        return F.col(c) if isinstance(c, str) else c
    boost = (
        F.when(col(publication_date).cast("string") >= recent_from, 0.1).otherwise(0.0)
        + F.when(col(base_amount) > high_value, 0.05).otherwise(0.0)
        + F.when(col(section_type) == "requirements", 0.15).otherwise(0.0)
    )
    return col(score) * (F.lit(1.0) + boost)


def within_budget(hits: DataFrame, max_tokens: int = MAX_CONTEXT_TOKENS, text_column: str = "text") -> DataFrame:
    """Leading hits of each query whose running token count stays within the budget."""
    running = F.sum("n_tokens").over(
        Window.partitionBy("qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    counted = hits.withColumn("n_tokens", token_count(text_column))
    return counted.withColumn("tokens_so_far", running).filter(F.col("tokens_so_far") <= max_tokens)


def group_by_tender(hits: DataFrame) -> DataFrame:
    """Order of hits for a context text: tenders in first-seen order, hits by rank inside.

    Adds ``tender_position`` and ``position`` per query; every hit stays its own row.
    """
    first_seen = F.min("rank").over(Window.partitionBy("qid", "tender_code"))
    seen = hits.withColumn("_first", first_seen)
    return seen.select(
        *hits.columns,
        F.dense_rank().over(Window.partitionBy("qid").orderBy("_first")).alias("tender_position"),
        F.row_number().over(Window.partitionBy("qid").orderBy("_first", "rank")).alias("position"))


def confidence(hits: DataFrame) -> DataFrame:
    """Mean score per query; a query without hits has no row."""
    return hits.groupBy("qid").agg(F.avg("score").alias("confidence"), F.count(F.lit(1)).alias("n_citations"))
