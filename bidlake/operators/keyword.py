"""Keyword retrieval: conjunctive containment, match-all fallback, boolean form and BM25."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from bidlake.functions.keywords import all_of
from bidlake.functions.text import WHITESPACE, contains_all, query_terms, tokens
from bidlake.operators.keyword_batch import matching, parsed
from bidlake.session import cut_lineage

QUERIES_PER_BLOCK = 200_000
BLOCK_CHARS = 8_000_000


def keyword_search(
    chunks: DataFrame, query: str, k: int = 5, id_column: str = "id", text_column: str = "text",
    output_fields: Sequence[str] | None = None,
) -> DataFrame:
    """Rows whose text contains every term of the query, cut to k by id; ``score`` is null.

    An empty query matches every row. The containment tests reach the parquet scan.
    """
    fields = [f for f in (output_fields or chunks.columns) if f != id_column]
    return (
        chunks.filter(contains_all(text_column, query_terms(query)))
        .select(F.lit(None).cast("double").alias("score"), id_column, *fields)
        .orderBy(id_column).limit(k)
    )


def keyword_search_many(
    queries: DataFrame, chunks: DataFrame, k: int = 5, qid_column: str = "qid", terms_column: str = "terms",
    id_column: str = "id", text_column: str = "text", block_size: int = QUERIES_PER_BLOCK, syntax: bool = False,
) -> DataFrame:
    """Top k per query as (qid, id, rank), ordered by id.

    A query asks for all of its whitespace-separated terms; with ``syntax`` it is read as boolean
    keyword syntax (``functions.keywords``). A query without terms matches every row. Up to
    ``block_size`` queries of about ``BLOCK_CHARS`` together become one automaton, which travels with
    the tasks; a text is read once per automaton and only (qid, id) pairs leave the scan stage, k per
    query and task reaching the ranking. Query ids are unique.
    """
    asked = queries.select(F.col(qid_column).alias("qid"), F.col(terms_column).cast("string").alias("query"))
    size = asked.agg(F.count(F.lit(1)).alias("n"), F.sum(F.length("query")).alias("chars")).first()
    n = max(-(-size.n // block_size), -(-(size.chars or 0) // BLOCK_CHARS), 1)
    texts = chunks.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    schema = T.StructType([T.StructField("qid", asked.schema["qid"].dataType), T.StructField("id", texts.schema["id"].dataType)])
    types = tuple(to_arrow_type(f.dataType) for f in schema)
    hits = None
    for block in range(n):
        # one block of bounded size at a time; its automaton is built in the tasks
        part = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("qid"), F.lit(n)) == block)
        held = part.toArrow()
        words = held.column("query").to_pylist()
        steps = parsed(words) if syntax else [all_of([x for x in re.split(WHITESPACE, w or "") if x]) for w in words]
        # plain tuples: a broadcast travels without the package
        shared = chunks.sparkSession.sparkContext.broadcast((held.column("qid").to_pylist(), [[tuple(s) for s in q] for q in steps]))
        found = texts.mapInArrow(matching(shared, not syntax, types), schema)
        hits = found if hits is None else hits.unionByName(found)
    order = Window.partitionBy("qid").orderBy("id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def bm25_search(
    chunks: DataFrame, query: str, k: int = 5, k1: float = 1.2, b: float = 0.75,
    id_column: str = "id", text_column: str = "text",
) -> DataFrame:
    """BM25 over lower-cased whitespace tokens: (id, score), rows without any term left out.

    Term counts are taken inside each row in one reading of the texts, and the collection statistics
    are one scalar aggregate of them, so nothing is exploded, joined or shuffled by term.
    """
    terms = sorted({t.lower() for t in query_terms(query)})
    if not terms:
        raise ValueError("BM25 needs at least one term")
    split = chunks.select(id_column, tokens(F.lower(text_column)).alias("_tokens"))
    n = F.size("_tokens")
    # texts are read once: what is left of them is a few numbers a row, for the statistics and the scores
    counts = cut_lineage(split.select(id_column, n.alias("_length"), *[
        (n - F.size(F.array_remove("_tokens", term))).alias(f"_tf{i}") for i, term in enumerate(terms)]))
    stats = counts.agg(F.struct(
        F.count(F.lit(1)).alias("n"), F.avg("_length").alias("mean_length"),
        *[F.count_if(F.col(f"_tf{i}") > 0).alias(f"df{i}") for i in range(len(terms))]).alias("s")).scalar()
    any_term = reduce(lambda x, y: x | y, [F.col(f"_tf{i}") > 0 for i in range(len(terms))])
    matched = counts.filter(any_term).withColumn("_stats", stats)
    score = F.lit(0.0)
    for i in range(len(terms)):
        n, df, tf = F.col("_stats.n"), F.col(f"_stats.df{i}"), F.col(f"_tf{i}")
        weight = F.log((n - df + 0.5) / (df + 0.5) + 1.0)
        length = F.lit(1.0 - b) + F.lit(b) * F.col("_length") / F.col("_stats.mean_length")
        score = score + weight * tf * (k1 + 1.0) / (tf + F.lit(k1) * length)
    scored = matched.select(F.col(id_column), (F.rint(score * 1e9) / 1e9).alias("score"))
    # every term weight is positive, so rows without a term come last and go after the cut
    return scored.orderBy(F.desc("score"), id_column).limit(k).filter("score > 0")
