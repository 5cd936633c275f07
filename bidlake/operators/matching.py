"""Vector matching inside groups: nearest rows of the own group, and late interaction of two groups.

Both meet rows of two sides that share a key in co-groups of bounded size: a key with more than
``block_rows`` rows on a side is cut into blocks by the hash of the row id, and every pair of blocks of
one key is a group of its own. Each group returns only what may win (k rows per query, or the best match
of each row), so a key that holds much of the table is spread like any other.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bidlake.functions.vectors import SCORE_DIGITS, best_first, mean_vector
from bidlake.operators.filtered_search import vector_topk_filtered
from bidlake.operators.vector_search import _Best, _score, _to_matrix
from bidlake.session import cut_lineage

BLOCK_ROWS = 16_384
# Up to so many keys of both sides are broadcast with their numbers of blocks; more of them are joined.
SHARED_KEYS = 100_000


def meet_in_blocks(left: DataFrame, right: DataFrame, keys: Sequence[str], function: Callable[[pa.Table, pa.Table], pa.Table],
                   schema: T.StructType, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``function`` of every pair of blocks (tables of ``left`` and ``right`` rows) that share ``keys``.

    Both sides have an ``id``. Keys on one side only are left out; null keys meet nothing.
    """
    def blocks(df: DataFrame, name: str) -> DataFrame:
        return df.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).alias(name))

    # keys of both sides only: the others would cost a task call each for nothing
    shared = cut_lineage(blocks(left, "n_left").join(blocks(right, "n_right"), list(keys)))
    few = shared.limit(SHARED_KEYS + 1).count() <= SHARED_KEYS

    def side(df: DataFrame, own: str, other: str) -> DataFrame:
        found = df.join(F.broadcast(shared) if few else shared, list(keys))
        every = F.explode(F.sequence(F.lit(0).cast("long"), F.col(f"n_{other}") - 1))
        return found.select(*[F.col(c).alias(c) for c in df.columns],
                            F.pmod(F.xxhash64("id"), F.col(f"n_{own}")).alias(f"_{own}"), every.alias(f"_{other}"))

    place = [*keys, "_left", "_right"]

    def met(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return pa.Table.from_batches([], pa.schema([(f.name, to_arrow_type(f.dataType)) for f in schema]))
        return function(a, b)

    return side(left, "left", "right").groupBy(*place).cogroup(side(right, "right", "left").groupBy(*place)).applyInArrow(met, schema)


def nearest_within(queries: DataFrame, rows: DataFrame, group: str, k: int = 5, metric: str = "IP", qid_column: str = "qid",
                   query_column: str = "query_vector", id_column: str = "id", vector_column: str = "embedding",
                   min_score: float | None = None, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """The k rows nearest to each query among the rows of its own ``group``: (group, qid, id, score, rank).

    A qid may occur once per group. Ties go to the smaller id; ``min_score`` keeps scores above it (L2:
    below). Rows and queries without a vector or group take no part; a vector of another width, or with a
    null or NaN component, fails the job. A group with fewer than k rows gives those.
    """
    left = queries.select(F.col(group).alias("key"), F.col(qid_column).alias("id"), F.col(query_column).cast("array<double>").alias("vector"))
    right = rows.select(F.col(group).alias("key"), F.col(id_column).alias("id"), F.col(vector_column).cast("array<double>").alias("vector"))
    left, right = left.filter("vector is not null"), right.filter("vector is not null")
    schema = T.StructType([T.StructField("key", left.schema["key"].dataType), T.StructField("qid", left.schema["id"].dataType),
                           T.StructField("id", right.schema["id"].dataType), T.StructField("score", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        dim = len(asked.column("vector")[0])
        found = _Best(_to_matrix(asked.column("vector"), dim), k, metric)
        ids, vectors = held.column("id").combine_chunks(), _to_matrix(held.column("vector"), dim)
        step = max(1, 4_000_000 // len(found.queries))
        for start in range(0, len(ids), step):
            found.add(ids.slice(start, step), vectors[start:start + step])
        batch = found.batch(asked.column("id").to_pylist(), (kinds[1], kinds[2]))
        key = pa.array([asked.column("key")[0].as_py()] * batch.num_rows, kinds[0])
        return pa.table([key, *batch.columns], names=["key", "qid", "id", "score"])

    partial = meet_in_blocks(left, right, ["key"], best, schema, block_rows)
    if min_score is not None:
        partial = partial.filter(F.col("score") < min_score if metric == "L2" else F.col("score") > min_score)
    order = Window.partitionBy("key", "qid").orderBy(best_first("score", metric), "id")
    ranked = partial.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.withColumnRenamed("key", group)


def late_interaction(pairs: DataFrame, chunks: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, target, score) per pair of ``pairs`` (source, target): for each chunk of the source its best inner
    product with a chunk of the target, summed. ``chunks`` is (owner, id, vector); pairs are distinct."""
    def side(end: str) -> DataFrame:
        return pairs.select("source", "target").join(chunks.withColumnRenamed("owner", end), end).select("source", "target", "id", "vector")

    left, right = side("source"), side("target")
    schema = T.StructType([left.schema["source"], left.schema["target"], left.schema["id"], T.StructField("best", T.DoubleType())])
    kinds = [to_arrow_type(f.dataType) for f in schema]

    def best(asked: pa.Table, held: pa.Table) -> pa.Table:
        dim = len(asked.column("vector")[0])
        queries, rows = _to_matrix(asked.column("vector"), dim), _to_matrix(held.column("vector"), dim)
        step = max(1, 4_000_000 // len(rows))
        top = np.concatenate([_score(queries[i:i + step], rows, "IP").max(axis=1) for i in range(0, len(queries), step)])
        return pa.table([*(pa.array([asked.column(c)[0].as_py()] * len(top), t) for c, t in zip(("source", "target"), kinds)),
                         asked.column("id").combine_chunks(), pa.array(top)], names=["source", "target", "id", "best"])

    matched = meet_in_blocks(left, right, ["source", "target"], best, schema, block_rows)
    return matched.groupBy("source", "target", "id").agg(F.max("best").alias("best")).groupBy("source", "target").agg(
        F.round(F.sum("best"), SCORE_DIGITS).alias("score"))


def similar_tenders(chunks: DataFrame, tenders: DataFrame, filters: Column, dim: int, k: int = 5, n_candidates: int = 50,
                    block_rows: int = BLOCK_ROWS) -> DataFrame:
    """Tenders most like each tender by late interaction of their chunks: (code, similar, score, rank).

    ``chunks`` is (tender_code, id, embedding), ``tenders`` has ``code`` and the fields that ``filters`` names:
    a JSON filter document per tender (see ``filtered_search``), such as the same division and an amount
    range. First the mean vectors of tenders under the filter give ``n_candidates`` each, itself left out;
    only those are compared chunk by chunk. Tenders without chunks take no part.
    """
    owned = chunks.filter(F.col("embedding").isNotNull() & F.col("tender_code").isNotNull())
    means = owned.groupBy(F.col("tender_code").alias("code")).agg(mean_vector("embedding", dim).alias("mean"))
    known = tenders.withColumn("_filter", filters).join(means, "code")
    # one candidate more than wanted, since a tender is always near itself
    near = vector_topk_filtered(known, known.drop("_filter"), n_candidates + 1, qid_column="code", query_column="mean", filter_column="_filter",
                                id_column="code", vector_column="mean")
    others = near.filter("qid <> id").withColumn("_nth", F.row_number().over(Window.partitionBy("qid").orderBy("rank")))
    # read by both sides and by the counts of their blocks, so the search for candidates runs once
    pairs = cut_lineage(others.filter(F.col("_nth") <= n_candidates).select(F.col("qid").alias("source"), F.col("id").alias("target")))
    scored = late_interaction(pairs, owned.select(F.col("tender_code").alias("owner"), "id", F.col("embedding").cast("array<double>").alias("vector")), block_rows)
    order = Window.partitionBy("source").orderBy(F.desc("score"), "target")
    ranked = scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select(F.col("source").alias("code"), F.col("target").alias("similar"), "score", "rank")
