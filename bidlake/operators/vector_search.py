"""Exact top-k similarity search over a collection of vectors.

One query: generated arithmetic over the scan and a distributed take-ordered, no shuffle.
Many queries: the query set is measured first. Up to ``QUERY_BYTES_LIMIT`` it travels with the
tasks and each Arrow batch of the collection is scored by one matrix product; a task keeps only
its k best rows per query, and those reach the shuffle. Beyond it both sides are cut into bounded blocks that meet
once per pair of blocks, again keeping only k rows per query and block pair.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.functions.vectors import METRICS, SCORE_DIGITS, best_first, similarity

DEFAULT_K = 5
QUERY_BYTES_LIMIT = 32 * 1024 * 1024
BLOCK_BYTES = 64 * 1024 * 1024
SCORES_AT_ONCE = 4_000_000


def vector_topk(
    collection: DataFrame,
    query: Sequence[float],
    k: int = DEFAULT_K,
    metric: str = "IP",
    id_column: str = "id",
    vector_column: str = "embedding",
    dim: int | None = None,
    output_fields: Sequence[str] | None = None,
    min_score: float | None = None,
) -> DataFrame:
    """The k rows most similar to one query vector, with ``score``; ties go to the smaller id.

    A filter on ``collection`` is evaluated before scoring. ``min_score`` keeps scores above it.
    Rows without a vector take no part; a vector of another width than the query's, or with a null
    or NaN component, fails the job.
    """
    if dim is not None and len(query) != dim:
        raise ValueError(f"Query embedding dim mismatch: expected {dim}")
    fields = [f for f in (output_fields or collection.columns) if f not in (vector_column, id_column)]
    scored = collection.filter(F.col(vector_column).isNotNull()).select(
        id_column, *fields, similarity(vector_column, query, metric).alias("score"))
    if min_score is not None:
        scored = scored.filter(F.col("score") > min_score)
    return scored.orderBy(best_first("score", metric), id_column).limit(k)


def vector_topk_many(
    queries: DataFrame,
    collection: DataFrame,
    k: int = DEFAULT_K,
    metric: str = "IP",
    qid_column: str = "qid",
    query_column: str = "query_vector",
    id_column: str = "id",
    vector_column: str = "embedding",
    query_bytes_limit: int = QUERY_BYTES_LIMIT,
    block_rows: int | None = None,
) -> DataFrame:
    """Top-k per query as (qid, id, score, rank). Rows and queries without a vector take no part;
    vectors of unequal width, or with a null or NaN component, fail the job on every path."""
    if metric not in METRICS:
        raise ValueError(f"metric must be one of {METRICS}")
    questions = queries.select(F.col(qid_column).alias("qid"), F.col(query_column).cast("array<double>").alias("vector")).filter("vector is not null")
    rows = collection.select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    schema = T.StructType([
        T.StructField("qid", questions.schema["qid"].dataType),
        T.StructField("id", rows.schema["id"].dataType),
        T.StructField("score", T.DoubleType()),
    ])
    # the width is read off the collection, which is stored, so that derived queries run only once
    stored = rows.filter("vector is not null").select(F.size("vector").alias("dim")).first()
    dim = stored.dim if stored else 1
    matrix = _bounded_matrix(questions, dim, query_bytes_limit) if stored else ([], np.zeros((0, 1)))
    if matrix is not None:
        partial = _score_with_broadcast(rows, matrix, k, metric, schema)
    else:
        partial = _score_by_blocks(questions, rows, k, metric, schema, block_rows or max(BLOCK_BYTES // (8 * max(dim, 1)), 1), dim)
    order = Window.partitionBy("qid").orderBy(best_first("score", metric), "id")
    return partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _bounded_matrix(questions: DataFrame, dim: int, limit: int) -> tuple[list, np.ndarray] | None:
    """The query set as (ids, matrix) if it fits ``limit`` bytes, else None. Never fetches more
    than the limit allows."""
    most = max(limit // (8 * max(dim, 1)), 1)
    fetched = questions.limit(most + 1).toArrow()
    if fetched.num_rows > most:
        return None
    return fetched.column("qid").to_pylist(), _to_matrix(fetched.column("vector"), dim)


def _to_matrix(vectors: pa.Array, dim: int) -> np.ndarray:
    """The vectors as rows; a vector of another width or with a null or NaN component is an error."""
    if isinstance(vectors, pa.ChunkedArray):
        vectors = vectors.combine_chunks()
    widths = pc.list_value_length(vectors).to_numpy(zero_copy_only=False)
    wrong = np.flatnonzero(widths != dim)
    if len(wrong):
        raise ValueError(f"Embedding dim mismatch: expected {dim}, got {widths[wrong[0]]}")
    components = vectors.flatten()
    flat = components.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if components.null_count or np.isnan(flat).any():
        raise ValueError("Embedding holds a null or NaN component")
    return flat.reshape(len(vectors), dim)


def _score(queries: np.ndarray, rows: np.ndarray, metric: str) -> np.ndarray:
    """queries × rows scores, rounded to the ranking precision."""
    if metric == "L2":
        # gaps squared one component at a time: the expanded form cancels for close or long vectors
        product = np.zeros((len(queries), len(rows)))
        for q, r in zip(queries.T, rows.T):
            gap = q[:, None] - r[None, :]
            product += gap * gap
    else:
        product = queries @ rows.T
    if metric == "COSINE":
        lengths = np.sqrt((queries**2).sum(axis=1))[:, None] * np.sqrt((rows**2).sum(axis=1))[None, :]
        product = np.divide(product, lengths, out=np.zeros_like(product), where=lengths > 0)
    scale = 10.0**SCORE_DIGITS
    return np.rint(product * scale) / scale


class _Best:
    """k best rows per query seen so far, ties by id; memory is queries × k."""

    def __init__(self, queries: np.ndarray, k: int, metric: str) -> None:
        self.queries, self.k, self.metric = queries, k, metric
        self.limit = np.full(len(queries), np.inf)
        self.q = np.zeros(0, dtype=np.int64)
        self.key = np.zeros(0)
        self.ids: np.ndarray | None = None

    def add(self, ids: pa.Array, rows: np.ndarray) -> None:
        self.merge([self.candidates(np.arange(len(self.queries)), ids, rows)])

    def candidates(self, chosen: np.ndarray, ids: pa.Array, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, key, id) of the rows that may be among the k best of the ``chosen`` queries."""
        key = _score(self.queries[chosen], rows, self.metric)
        if self.metric != "L2":
            key = -key
        limit = self.limit[chosen]
        if key.shape[1] >= self.k:
            limit = np.minimum(limit, np.partition(key, self.k - 1, axis=1)[:, self.k - 1])
        q, r = np.nonzero(key <= limit[:, None])
        return chosen[q], key[q, r], ids.to_numpy(zero_copy_only=False)[r]

    def merge(self, found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> None:
        """Take in candidates, keeping k per query."""
        if self.ids is not None:
            found = [(self.q, self.key, self.ids), *found]
        q, key, names = (np.concatenate(part) for part in zip(*found, strict=True))
        name_order = np.unique(names, return_inverse=True)[1]
        order = np.lexsort((name_order, key, q))
        q, key, names = q[order], key[order], names[order]
        nth = np.arange(len(q)) - np.searchsorted(q, q)
        kept = nth < self.k
        self.q, self.key, self.ids = q[kept], key[kept], names[kept]
        full = nth[kept] == self.k - 1
        self.limit[self.q[full]] = self.key[full]

    def batch(self, qids: list, types: tuple[pa.DataType, pa.DataType]) -> pa.RecordBatch:
        scores = self.key if self.metric == "L2" else -self.key
        names = [] if self.ids is None else self.ids
        return pa.RecordBatch.from_arrays([
            pa.array([qids[i] for i in self.q], type=types[0]),
            pa.array(names, type=types[1]),
            pa.array(scores + 0.0, type=pa.float64()),
        ], names=["qid", "id", "score"])


def _arrow_types(schema: T.StructType) -> tuple[pa.DataType, pa.DataType]:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(schema["qid"].dataType), to_arrow_type(schema["id"].dataType)


def _score_with_broadcast(rows: DataFrame, matrix: tuple[list, np.ndarray], k: int, metric: str,
                          schema: T.StructType) -> DataFrame:
    spark = rows.sparkSession
    shared = spark.sparkContext.broadcast(matrix)
    types = _arrow_types(schema)
    dim = matrix[1].shape[1]

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        qids, queries = shared.value
        found = _Best(queries, k, metric)
        step = max(1, SCORES_AT_ONCE // max(len(qids), 1))
        for batch in batches:
            for start in range(0, batch.num_rows if qids else 0, step):
                part = batch.slice(start, step)
                found.add(part.column(0), _to_matrix(part.column(1), dim))
        yield found.batch(qids, types)

    return rows.filter("vector is not null").mapInArrow(best, schema)


def _score_by_blocks(questions: DataFrame, rows: DataFrame, k: int, metric: str, schema: T.StructType,
                     size: int, dim: int) -> DataFrame:
    """Cut both sides into blocks of about ``size`` rows; every pair of blocks is one group.

    What is shuffled is each side once per block of the other, so large blocks keep it low. The
    block of a row is the hash of its (unique) id: even and reproducible.
    """
    rows = rows.filter("vector is not null")
    n_q = max(1, -(-questions.count() // size))
    n_r = max(1, -(-rows.count() // size))

    def blocks(own: str, n: int, other: str, n_other: int, df: DataFrame, key: str) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_other - 1).cast("long")))
        return df.withColumn(own, F.pmod(F.xxhash64(key), F.lit(n))).withColumn(other, every)

    left = blocks("qb", n_q, "rb", n_r, questions, "qid").groupBy("qb", "rb")
    right = blocks("rb", n_r, "qb", n_q, rows, "id").groupBy("qb", "rb")
    types = _arrow_types(schema)

    def best(q_block: pa.Table, r_block: pa.Table) -> pa.Table:
        qids = q_block.column("qid").to_pylist()
        if not qids or not r_block.num_rows:
            return pa.Table.from_batches([_Best(np.zeros((0, 1)), k, metric).batch([], types)])
        found = _Best(_to_matrix(q_block.column("vector"), dim), k, metric)
        ids, vectors = r_block.column("id").combine_chunks(), _to_matrix(r_block.column("vector"), dim)
        step = max(1, SCORES_AT_ONCE // len(qids))
        for start in range(0, len(ids), step):
            found.add(ids.slice(start, step), vectors[start:start + step])
        return pa.Table.from_batches([found.batch(qids, types)])

    return left.cogroup(right).applyInArrow(best, schema)
