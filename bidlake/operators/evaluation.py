"""Retrieval metrics and index quality."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.functions.vectors import norm


def retrieval_metrics(hits: DataFrame, n_relevant: DataFrame, k: int) -> DataFrame:
    """Per query P@k, R@k, MRR and nDCG@k from hits (qid, rank, relevant) and the number of
    relevant items (qid, n_relevant). A query without relevant items scores 0, not an error."""
    gain = F.when(F.col("relevant"), 1.0 / F.log2(F.col("rank") + 1.0)).otherwise(0.0)
    found = hits.filter(F.col("rank") <= k).groupBy("qid").agg(
        F.count_if("relevant").alias("n_found"),
        F.coalesce(F.max(F.when(F.col("relevant"), 1.0 / F.col("rank"))), F.lit(0.0)).alias("mrr"),
        F.sum(gain).alias("dcg"))
    ideal = F.aggregate(
        F.sequence(F.lit(1), F.greatest(F.least(F.col("n_relevant"), F.lit(k)), F.lit(1)).cast("int")),
        F.lit(0.0), lambda acc, r: acc + 1.0 / F.log2(r + 1.0))
    joined = n_relevant.join(found, "qid", "left")
    n_found = F.coalesce("n_found", F.lit(0))
    return joined.select(
        "qid",
        (n_found / F.lit(float(k))).alias("precision_at_k"),
        F.when(F.col("n_relevant") > 0, n_found / F.col("n_relevant")).otherwise(0.0).alias("recall_at_k"),
        F.coalesce("mrr", F.lit(0.0)).alias("mrr"),
        F.when(F.col("n_relevant") > 0, F.coalesce("dcg", F.lit(0.0)) / ideal).otherwise(0.0).alias("ndcg_at_k"))


def mean_metrics(per_query: DataFrame) -> DataFrame:
    return per_query.agg(
        F.count(F.lit(1)).alias("n_queries"),
        *[F.avg(c).alias(c) for c in ("precision_at_k", "recall_at_k", "mrr", "ndcg_at_k")])


def embedding_quality(collection: DataFrame, dim: int, vector_column: str = "embedding") -> DataFrame:
    """One row: total, valid vectors (right width, no null or zero vector) and their average
    pairwise cosine similarity.

    The average over all pairs follows from the length of the summed unit vectors:
    (|Σu|² − n) / (n (n − 1)), so no pair is formed.
    """
    vector = F.col(vector_column)
    length = norm(vector_column)
    valid = vector.isNotNull() & (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    unit = collection.select(vector.alias("_v"), F.coalesce(F.when(valid, length > 0), F.lit(False)).alias("_ok"),
                             F.when(valid, length).alias("_len"))
    sums = [F.sum(F.when(F.col("_ok"), F.get("_v", F.lit(i)).cast("double") / F.nullif("_len", F.lit(0.0))))
            for i in range(dim)]
    totals = unit.agg(F.count(F.lit(1)).alias("total"), F.count_if("_ok").alias("valid_count"),
                      F.array(*sums).alias("_sum"))
    n = F.col("valid_count").cast("double")
    square = F.aggregate("_sum", F.lit(0.0), lambda acc, x: acc + x * x)
    return totals.select(
        "total", "valid_count",
        F.when(n > 1, (square - n) / F.nullif(n * (n - 1), F.lit(0.0))).alias("avg_similarity"))
