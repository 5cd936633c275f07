"""Answering questions: retrieve, fuse, enrich, rerank, assemble."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.text import euros, percent, route
from bidlake.operators import fusion, graph
from bidlake.operators.keyword import keyword_search, keyword_search_many
from bidlake.operators.vector_search import vector_topk, vector_topk_many


def hybrid_search(
    collection: DataFrame, query: str, query_vector: Sequence[float], k: int = 5, alpha: float = fusion.ALPHA,
    mode: str = "max", reranker: fusion.Reranker | None = None, id_column: str = "id", text_column: str = "text",
    vector_column: str = "embedding",
) -> DataFrame:
    """Vector and keyword hits of one question, fused, reranked and cut to k."""
    base = collection.withColumn("id", F.col(id_column).cast("string"))
    one = Window.orderBy(F.desc("score"), "id")
    vector = vector_topk(base, query_vector, k, vector_column=vector_column)
    vector = vector.select(F.lit(0).alias("qid"), F.row_number().over(one).alias("ord"), "*")
    keyword = keyword_search(base.drop(vector_column), query, k, text_column=text_column)
    keyword = keyword.select(F.lit(0).alias("qid"), F.row_number().over(Window.orderBy("id")).alias("ord"), "*")
    return fusion.rerank(fusion.hybrid_fusion(vector, keyword, alpha, mode=mode), k, reranker).drop("qid")


def hybrid_search_many(
    queries: DataFrame, vectors: DataFrame, chunks: DataFrame, k: int = 5,
    alpha: float = fusion.ALPHA, mode: str = "max",
) -> DataFrame:
    """Many questions at once: queries (qid, terms, query_vector), vectors (id, embedding) and
    chunks (id, text)."""
    vector = vector_topk_many(queries, vectors, k).withColumnRenamed("rank", "ord")
    keyword = keyword_search_many(queries, chunks, k).select(
        "qid", F.col("rank").alias("ord"), "id", F.lit(None).cast("double").alias("score"))
    return fusion.hybrid_fusion(vector, keyword, alpha, k, mode)


def enrich(hits: DataFrame, context: DataFrame, keep_all: bool = False) -> DataFrame:
    """Add tender context (``chunk_context`` columns) to hits; hits without one are dropped
    unless ``keep_all``."""
    return hits.join(context.withColumnRenamed("chunk_id", "id"), "id", "left" if keep_all else "inner")


def search_with_context(hits: DataFrame, chunks: DataFrame, tenders: DataFrame, k: int,
                        recent_from: str = "2025-01-01") -> DataFrame:
    """Over-fetched hits (2k per query) enriched, boosted by tender features and cut to k."""
    enriched = enrich(hits, graph.chunk_context(hits, chunks, tenders, extra=("section_type",)))
    boosted = fusion.rescored(fusion.metadata_boost(recent_from=recent_from))
    return fusion.rerank(enriched, k, boosted)


def search_within(earlier: DataFrame, collection: DataFrame, query_vector: Sequence[float], k: int = 5,
                  id_column: str = "id") -> DataFrame:
    """Search only among the ids of earlier results."""
    ids = earlier.select(id_column).distinct()
    return vector_topk(collection.join(ids, id_column, "left_semi"), query_vector, k, id_column=id_column)


def expand_by_related(hits: DataFrame, tenders: DataFrame, chunks: DataFrame, section: str = "requirements",
                      n_tenders: int = 3, n_related: int = 2, n_chunks: int = 3) -> DataFrame:
    """Chunks of tenders related to the leading tenders of a result, a few each."""
    leading = (hits.groupBy("tender_code").agg(F.min("rank").alias("first")).orderBy("first", "tender_code")
               .limit(n_tenders))
    # at most ``n_tenders`` rows come to the driver, and turn the later scans into literal filters
    sources = tenders.filter(F.col("code").isin([row.tender_code for row in leading.collect()]))
    asked = sources.select(F.substring("cpv_code", 1, 2).alias("division"), "buyer_name").collect()
    near = [F.col("cpv_code").startswith(row.division) for row in asked if row.division is not None]
    near += [F.col("buyer_name") == row.buyer_name for row in asked if row.buyer_name is not None]
    candidates = tenders.filter(reduce(lambda x, y: x | y, near, F.lit(False)))
    related = graph.related_tenders_many(candidates, sources, n_related).select(
        "source_code", F.col("code").alias("tender_code"), "similarity_score")
    wanted = chunks.filter(F.col("section_type") == section)
    # the first chunks per tender are chosen before the join, so a tender related to several is ranked once
    first = Window.partitionBy("tender_code").orderBy("chunk_index", "id")
    few = wanted.withColumn("_n", F.row_number().over(first)).filter(F.col("_n") <= n_chunks).drop("_n")
    return related.join(few, "tender_code").select(
        "source_code", "tender_code", "similarity_score", F.col("id").alias("chunk_id"), "section_type")


def graph_first(tenders: DataFrame, lots: DataFrame, requirements: DataFrame, mentioned_in: DataFrame,
                chunks: DataFrame, code: str | None = None) -> DataFrame:
    """Mandatory requirements with the text of the chunks that state them."""
    chain = graph.mandatory_requirements(tenders, lots, requirements, code)
    linked = graph.requirement_sections(chain, mentioned_in)
    return linked.join(chunks.select(F.col("id").alias("chunk_id"), "text"), "chunk_id")


def vector_first(hits: DataFrame, mentioned_in: DataFrame) -> DataFrame:
    """Hits with the requirements stated in them; hits without any stay."""
    return hits.join(mentioned_in.withColumnRenamed("chunk_id", "id"), "id", "left")


def answer_questions(
    questions: DataFrame, retrieve: Callable[[DataFrame], DataFrame],
    rewrite: Callable[[DataFrame], DataFrame] | None = None, k: int = 5,
    reranker: fusion.Reranker | None = None, max_tokens: int = fusion.MAX_CONTEXT_TOKENS,
    generate: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rewrite, retrieve, rerank, assemble and generate for ``questions`` (qid, question).

    ``rewrite`` returns the questions as retrieval shall see them; ``retrieve`` maps them to hits
    (qid, rank, id, score, text, …). The prompt holds the question as it was asked, and a question
    without hits still gets its row.
    """
    hits = retrieve(rewrite(questions) if rewrite else questions)
    return answer_context(hits, questions, k, reranker, max_tokens, generate)


def answer_context(
    hits: DataFrame, questions: DataFrame | None = None, k: int = 5,
    reranker: fusion.Reranker | None = None, max_tokens: int = fusion.MAX_CONTEXT_TOKENS,
    generate: Callable[[Column], Column] | None = None,
) -> DataFrame:
    """Rerank, keep what fits the token budget and mark citations; with ``generate`` (a function
    on the prompt column, e.g. a pandas UDF around a model) also the answer per question.

    ``hits``: (qid, rank, id, score, text, …). With ``questions`` (qid, question) every question is
    answered, from an empty context if nothing was found; else the hits carry ``question``, and
    no hits give no rows.
    """
    chosen = fusion.within_budget(fusion.rerank(hits, k, reranker), max_tokens)
    if generate is None:
        return chosen
    # at most k texts per question, within the budget
    prompts = chosen.groupBy("qid", *(["question"] if questions is None else [])).agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda c: c["text"]), "\n\n")
        .alias("context"), F.count(F.lit(1)).alias("n_citations"))
    if questions is not None:
        prompts = questions.select("qid", "question").join(prompts, "qid", "left").select(
            "qid", "question", F.coalesce("context", F.lit("")).alias("context"),
            F.coalesce("n_citations", F.lit(0)).alias("n_citations"))
    prompt = F.concat(F.lit("CONTEXT:\n"), "context", F.lit("\n\nQUESTION: "), "question")
    return prompts.select("qid", "question", "n_citations", generate(prompt).alias("answer"))


def citations(hits: DataFrame) -> DataFrame:
    return hits.select("id", "section_path", "page_numbers", "metadata", "source_chunk_id")


def context_lines(hits: DataFrame) -> DataFrame:
    """Printable heading and relevance of each hit, in context order."""
    return fusion.group_by_tender(hits).select(
        "qid", "position", "tender_code",
        F.concat(F.lit("TENDER: "), "tender_title", F.lit(" | Buyer: "), "buyer_name", F.lit(" | Amount: "),
                 euros("base_amount")).alias("heading"),
        percent(F.col("score")).alias("relevance"))


def deadlines_of(questions: DataFrame, deadlines: DataFrame, k: int = 5) -> DataFrame:
    """The graph alone: the k earliest deadlines of each question's tender; undated ones come last."""
    order = Window.partitionBy("qid").orderBy(F.asc_nulls_last("date"), "type", "notes")
    found = questions.select("qid", "tender_code").join(deadlines, "tender_code")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    named = F.concat_ws(" ", "type", F.col("date").cast("string"), "notes")
    return found.select("qid", "rank", named.alias("id"), F.lit("deadline").alias("kind"), F.lit(None).cast("double").alias("score"))


def requirements_of(questions: DataFrame, tenders: DataFrame, lots: DataFrame, requirements: DataFrame, mentioned_in: DataFrame,
                    k: int = 5) -> DataFrame:
    """The graph first: k chunks that state a mandatory requirement of each question's tender."""
    asked = questions.select("qid", "tender_code")
    # the chain starts from the tenders asked about, not from all of them
    own = lots.join(asked.select("tender_code").distinct(), "tender_code", "left_semi")
    chain = graph.mandatory_requirements(tenders, own, requirements).select("tender_code", "requirement_id").distinct()
    found = graph.requirement_sections(chain, mentioned_in).select("tender_code", "chunk_id").distinct().join(asked, "tender_code")
    order = Window.partitionBy("qid").orderBy("chunk_id")
    found = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return found.select("qid", "rank", F.col("chunk_id").alias("id"), F.lit("chunk").alias("kind"), F.lit(None).cast("double").alias("score"))


def nearest_chunks(questions: DataFrame, collection: DataFrame, k: int = 5) -> DataFrame:
    """The vectors first: the k chunks nearest to each question's ``query_vector``."""
    found = vector_topk_many(questions, collection, k)
    return found.select("qid", "rank", F.col("id").cast("string").alias("id"), F.lit("vector").alias("kind"), "score")


def routed_search(questions: DataFrame, branches: Mapping[str, Callable[[DataFrame], DataFrame]], route_of: Column | None = None) -> DataFrame:
    """Answer every question by the strategy it is routed to: (qid, route, rank, id, kind, score).

    ``questions`` has ``qid``, ``question`` and what the branches need; ``branches`` maps each strategy to a
    plan from its questions to (qid, rank, id, kind, score). One small job finds which strategies occur,
    and the others are not planned at all. A strategy without a branch fails; a null question takes the
    default strategy; questions without hits have no rows.
    """
    dealt = questions.withColumn("route", route(F.coalesce("question", F.lit(""))) if route_of is None else route_of)
    used = sorted(row.route for row in dealt.select("route").distinct().collect())
    missing = [name for name in used if name not in branches]
    if missing:
        raise ValueError(f"no branch for {', '.join(missing)}")
    shape = ["qid", "route", "rank", "id", "kind", "score"]
    found = [branches[name](dealt.filter(F.col("route") == name).drop("route")).withColumn("route", F.lit(name)).select(*shape)
             for name in used or list(branches)[:1]]
    return reduce(DataFrame.unionByName, found)
