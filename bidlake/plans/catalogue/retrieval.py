"""Search, fusion, reranking, context and evaluation."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidlake.functions import text as X
from bidlake.functions.vectors import length_embedding, mean_vector
from bidlake.operators import evaluation, fusion, graph, matching
from bidlake.operators.filtered_search import vector_topk_filtered
from bidlake.operators.keyword import bm25_search, keyword_search, keyword_search_many
from bidlake.operators.vector_search import vector_topk, vector_topk_many
from bidlake.plans import ingest, retrieval
from bidlake.plans.catalogue.registry import query
from bidlake.sources import domain

KEYWORDS = "the ing"

_DOT = "round(list_dot_product(v.embedding::double[], q.embedding::double[]), 9)"
_FIRST = "q as (select embedding from embeddings order by vec_id limit 1)"


def first_vector(t):
    """The query of the single-question searches: the vector with the smallest id."""
    return t.embeddings.orderBy("vec_id").select("embedding").first().embedding


def rounded(df, column="score"):
    return df.withColumn(column, F.round(column, 6))


@query("r1_vector_topk", f"""with {_FIRST}
    select v.vec_id as id, v.label, round({_DOT}, 6) as score from embeddings v, q order by {_DOT} desc, id limit 5""")
def r1(t):
    return rounded(vector_topk(domain.vectors(t), first_vector(t), 5, dim=64))


@query("r1_vector_l2", f"""with {_FIRST}, s as (
    select v.vec_id as id, v.label, round(list_sum(list_transform(list_zip(v.embedding::double[], q.embedding::double[]),
        lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as d from embeddings v, q)
    select id, label, round(d, 6) as score from s order by d, id limit 5""")
def r1_l2(t):
    return rounded(vector_topk(domain.vectors(t), first_vector(t), 5, "L2"))


@query("r1_vector_cosine", f"""with {_FIRST}, s as (
    select v.vec_id as id, v.label, round(list_cosine_similarity(v.embedding::double[], q.embedding::double[]), 9) as c from embeddings v, q)
    select id, label, round(c, 6) as score from s order by c desc, id limit 5""")
def r1_cosine(t):
    return rounded(vector_topk(domain.vectors(t), first_vector(t), 5, "COSINE"))


@query("f12_filtered_search", f"""with {_FIRST}
    select v.vec_id as id, v.label, round({_DOT}, 6) as score from embeddings v, q where label in (2, 5) order by {_DOT} desc, id limit 10""")
def filtered_search(t):
    return rounded(vector_topk(domain.vectors(t).filter(F.col("label").isin(2, 5)), first_vector(t), 10))


@query("f14_score_threshold", f"""with {_FIRST}
    select v.vec_id as id, v.label, round({_DOT}, 6) as score from embeddings v, q where {_DOT} > 0.2 order by {_DOT} desc, id limit 20""")
def score_threshold(t):
    return rounded(vector_topk(domain.vectors(t), first_vector(t), 20, min_score=0.2))


@query("f15_search_within", f"""with {_FIRST}, early as (
    select v.vec_id from embeddings v, q order by {_DOT} desc, vec_id limit 50),
    n as (select embedding from embeddings order by vec_id desc limit 1)
    select v.vec_id as id, v.label, round(list_dot_product(v.embedding::double[], n.embedding::double[]), 6) as score
    from embeddings v, n where v.vec_id in (select vec_id from early)
    order by round(list_dot_product(v.embedding::double[], n.embedding::double[]), 9) desc, id limit 5""")
def search_within(t):
    vectors = domain.vectors(t)
    earlier = vector_topk(vectors, first_vector(t), 50)
    last = t.embeddings.orderBy(F.desc("vec_id")).select("embedding").first().embedding
    return rounded(retrieval.search_within(earlier, vectors, last, 5))


@query("r2_keyword", """
    select cast(null as double) as score, id, text from v_chunk where text like '%the%' and text like '%ing%' order by id limit 20""",
       "v_chunk")
def keyword(t):
    return keyword_search(domain.chunks(t), KEYWORDS, 20, output_fields=["text"])


@query("r14_bm25", r"""
    with d as (select doc_id, list_filter(regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as toks from documents),
    c as (select doc_id, len(toks) as n, len(list_filter(toks, lambda x: x = 'the')) as a, len(list_filter(toks, lambda x: x = 'und')) as b,
                 len(list_filter(toks, lambda x: x = 'que')) as c from d),
    s as (select count(*) as n, avg(n) as mean, count(*) filter (where a > 0) as da, count(*) filter (where b > 0) as db,
                 count(*) filter (where c > 0) as dc from c),
    r as (select doc_id, round(
        ln((s.n - da + 0.5e0) / (da + 0.5e0) + 1) * a * 2.2e0 / (a + 1.2e0 * (0.25e0 + 0.75e0 * c.n / mean))
      + ln((s.n - dc + 0.5e0) / (dc + 0.5e0) + 1) * c * 2.2e0 / (c + 1.2e0 * (0.25e0 + 0.75e0 * c.n / mean))
      + ln((s.n - db + 0.5e0) / (db + 0.5e0) + 1) * b * 2.2e0 / (b + 1.2e0 * (0.25e0 + 0.75e0 * c.n / mean)), 9) as score
      from c, s where a > 0 or b > 0 or c > 0)
    select doc_id, round(score, 6) as score from r order by r.score desc, doc_id limit 20""")
def bm25(t):
    return rounded(bm25_search(domain.documents(t), "The und QUE", 20, id_column="doc_id"))


# One question over documents and their vectors, as hit lists of ten.
_HYBRID = f"""with {_FIRST},
    vec as (select *, row_number() over (order by s desc, id) as ord from (
        select v.vec_id as id, {_DOT} as s from embeddings v, q) order by s desc, id limit 10),
    kw as (select doc_id as id, 1000000 + row_number() over (order by doc_id) as ord from documents
           where text like '%the%' and text like '%ing%' order by doc_id limit 10),
    both_sides as (select id, ord, 0.7e0 * s / (select max(s) from vec) as score, 0 as side from vec
                   union all select id, ord, 1e0 - 0.7e0, 1 from kw),"""


def hybrid_lists(t, k=10):
    one = F.lit(0).alias("qid")
    vector = vector_topk(domain.vectors(t), first_vector(t), k).select(
        one, F.row_number().over(Window.orderBy(F.desc("score"), "id")).alias("ord"), "id", "score")
    words = keyword_search(t.documents, KEYWORDS, k, "doc_id", output_fields=["doc_id"]).select(
        one, F.row_number().over(Window.orderBy("doc_id")).alias("ord"), F.col("doc_id").alias("id"), "score")
    return vector, words


@query("r3_hybrid_max", _HYBRID + """
    best as (select id, score, min(ord) over (partition by id) as first from both_sides
             qualify row_number() over (partition by id order by score desc, ord) = 1)
    select id, round(score, 6) as score, cast(row_number() over (order by score desc, first) as int) as rank
    from best order by rank limit 10""")
def hybrid_max(t):
    return rounded(fusion.hybrid_fusion(*hybrid_lists(t), k=10).select("id", "score", "rank"))


@query("r3_hybrid_sum", _HYBRID + """
    total as (select id, sum(score) as score, min(ord) as first from both_sides group by id)
    select id, round(score, 6) as score, cast(row_number() over (order by score desc, first) as int) as rank
    from total order by rank limit 10""")
def hybrid_sum(t):
    return rounded(fusion.hybrid_fusion(*hybrid_lists(t), k=10, mode="sum").select("id", "score", "rank"))


# Centroid questions: the mean vector of every label, asked of all vectors.
_CENTROID = f"""
    centroid as (select label as qid, list(m order by i) as v from (
        select label, i, avg(cast(embedding[i] as double)) as m from embeddings, range(1, 65) r(i) group by all) group by label),
    hit as (select qid, vec_id as id, label, round(list_dot_product(embedding::double[], c.v), 9) as score
            from embeddings, centroid c qualify row_number() over (partition by qid order by
            round(list_dot_product(embedding::double[], c.v), 9) desc, vec_id) <= 10)"""


def centroids(t):
    return t.embeddings.groupBy(F.col("label").alias("qid")).agg(mean_vector("embedding", 64).alias("query_vector"))


@query("r9_centroid_search", f"""with {_CENTROID}
    select qid, id, round(score, 6) as score, cast(row_number() over (partition by qid order by hit.score desc, id) as int) as rank from hit""")
def centroid_search(t):
    return rounded(vector_topk_many(centroids(t), domain.vectors(t), 10))


@query("r9_batch_search", """
    with q as (select item_id as qid, list_transform(range(64), lambda i: length(text) / 1000.0e0 + i / 64.0e0) as v from benchmark),
    s as (select qid, vec_id as id, round(list_dot_product(embedding::double[], q.v), 9) as score from embeddings, q)
    select qid, id, round(score, 6) as score, cast(row_number() over (partition by qid order by s.score desc, id) as int) as rank
    from s qualify row_number() over (partition by qid order by s.score desc, id) <= 5""")
def batch_search(t):
    questions = domain.questions(t).select("qid", length_embedding("question", 64).alias("query_vector"))
    return rounded(vector_topk_many(questions, domain.vectors(t), 5))


@query("r9_batch_blocks", """
    with q as (select item_id as qid, list_transform(range(64), lambda i: length(text) / 1000.0e0 + i / 64.0e0) as v from benchmark),
    s as (select qid, vec_id as id, round(list_sum(list_transform(list_zip(embedding::double[], q.v),
              lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 9) as score from embeddings, q)
    select qid, id, round(score, 5) as score, cast(row_number() over (partition by qid order by s.score, id) as int) as rank
    from s qualify row_number() over (partition by qid order by s.score, id) <= 3""")
def batch_blocks(t):
    """The path for query sets beyond the size limit, forced by a limit of one query."""
    questions = domain.questions(t).select("qid", length_embedding("question", 64).alias("query_vector"))
    found = vector_topk_many(questions, domain.vectors(t), 3, "L2", query_bytes_limit=1)
    return found.withColumn("score", F.round("score", 5))


# Each label asks for the vectors near its mean, every one under a filter document of its own.
_FILTERS = (
    '{"lang": "en"}', '{"source": {"$in": ["src1", "src4", "src9"]}, "n_chars": {"$gte": 500}}',
    '{"$or": [{"lang": "de"}, {"label": {"$lt": 3}}]}', '{"n_chars": {"$gt": 300, "$lte": 4000.5}, "lang": {"$ne": "fr"}}', None)


@query("f12_batch_filters", f"""with {_CENTROID},
    rows as (select vec_id as id, embedding, label, lang, source, n_chars from embeddings join documents on doc_id = vec_id),
    scored as (select qid, id, round(list_dot_product(embedding::double[], c.v), 9) as score from rows, centroid c
        where case qid % 5 when 0 then lang = 'en' when 1 then source in ('src1', 'src4', 'src9') and n_chars >= 500
            when 2 then lang = 'de' or label < 3 when 3 then n_chars > 300 and n_chars <= 4000.5 and lang <> 'fr' else true end)
    select qid, id, round(score, 6) as score, cast(row_number() over (partition by qid order by scored.score desc, id) as int) as rank
    from scored qualify row_number() over (partition by qid order by scored.score desc, id) <= 10""")
def batch_filters(t):
    documents = F.array(*map(F.lit, _FILTERS))
    questions = centroids(t).withColumn("filter", F.get(documents, (F.col("qid") % len(_FILTERS)).cast("int")))
    fields = t.documents.select(F.col("doc_id").alias("id"), "lang", "source", "n_chars")
    return rounded(vector_topk_filtered(questions, domain.vectors(t).join(fields, "id"), 10))


# Chunks of a tender for matching: five vectors each, in the order of their ids.
_CHUNK_VECTORS = "c as (select cast(vec_id // 5 as varchar) as code, vec_id as id, embedding::double[] as v from embeddings)"


def chunk_vectors(t):
    return t.embeddings.select(F.expr("vec_id div 5").cast("string").alias("tender_code"), F.col("vec_id").alias("id"), "embedding")


@query("a11_similar_tenders", f"""with {_CHUNK_VECTORS},
    m as (select code, list(x order by i) as mean from (
        select code, i, avg(v[i]) as x from c, range(1, 65) r(i) group by all) group by code),
    known as (select m.code, mean, base_amount, substring(cpv_code, 1, 1) as area from m join v_tender t on t.code = m.code),
    near as (select a.code as source, b.code as target from known a join known b
        on b.base_amount >= 0.5 * a.base_amount and b.base_amount <= 2 * a.base_amount and (a.area = b.area or b.area = '7') and a.code <> b.code
        qualify row_number() over (partition by a.code order by round(list_dot_product(a.mean, b.mean), 9) desc, b.code) <= 8),
    best as (select source, target, x.id, max(round(list_dot_product(x.v, y.v), 9)) as best
             from near join c x on x.code = source join c y on y.code = target group by all),
    scored as (select source, target, round(sum(best), 9) as s from best group by all)
    select source as code, target as similar, round(s, 6) as score, cast(row_number() over (partition by source order by s desc, target) as int) as rank
    from scored qualify row_number() over (partition by source order by s desc, target) <= 3""", "v_tender")
def similar(t):
    known = domain.tenders(t).withColumn("area", F.substring("cpv_code", 1, 1))
    either = F.array(*[F.struct(F.struct(a.alias("$eq")).alias("area")) for a in (F.col("area"), F.lit("7"))])
    filters = F.to_json(F.struct(
        F.struct((0.5 * F.col("base_amount")).alias("$gte"), (2 * F.col("base_amount")).alias("$lte")).alias("base_amount"), either.alias("$or")))
    return rounded(matching.similar_tenders(chunk_vectors(t), known, filters, 64, k=3, n_candidates=8))


@query("j15_evidence", f"""with {_CHUNK_VECTORS},
    r as (select distinct tender_code, requirement_id, description from v_lot join v_requirement q on q.id = requirement_id where mandatory),
    s as (select tender_code, requirement_id, c.id as chunk_id,
                 round(list_dot_product(c.v, list_transform(range(64), lambda i: length(description) / 1000.0e0 + i / 64.0e0)), 9) as score
          from r join c on c.code = tender_code)
    select tender_code, requirement_id, chunk_id, round(score, 6) as score,
           cast(row_number() over (partition by tender_code, requirement_id order by s.score desc, chunk_id) as int) as rank
    from s qualify row_number() over (partition by tender_code, requirement_id order by s.score desc, chunk_id) <= 3""", "v_lot v_requirement")
def evidence(t):
    """The chunks of its own tender nearest to each mandatory requirement."""
    required = domain.lots(t).select("tender_code", "requirement_id").distinct().join(
        domain.requirements(t).filter("mandatory").withColumnRenamed("id", "requirement_id"), "requirement_id")
    asked = required.select("tender_code", "requirement_id", length_embedding("description", 64).alias("query_vector"))
    found = matching.nearest_within(asked, chunk_vectors(t), "tender_code", 3, qid_column="requirement_id")
    return rounded(found.select("tender_code", F.col("qid").alias("requirement_id"), F.col("id").alias("chunk_id"), "score", "rank"))


# Every question as a whole is the keyword query: all of its terms must occur in the text.
_KEYWORD_HITS = r"""
    asked as (select item_id as qid, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as terms
              from benchmark),
    found as (select qid, doc_id as id from asked, documents
              where len(list_filter(terms, lambda x: text not like concat('%', x, '%'))) = 0)"""


@query("r9_batch_keywords", f"""with {_KEYWORD_HITS}
    select qid, id, cast(row_number() over (partition by qid order by id) as int) as rank
    from found qualify row_number() over (partition by qid order by id) <= 5""")
def batch_keywords(t):
    questions = domain.questions(t).withColumnRenamed("question", "terms")
    return keyword_search_many(questions, domain.documents(t).withColumnRenamed("doc_id", "id"), 5)


@query("r8_multi_query", f"""with {_CENTROID},
    m as (select 0 as qid, id, max(score) as score, count(*) as n_variants from hit group by id)
    select qid, id, round(score, 6) as score, n_variants, cast(row_number() over (order by m.score desc, id) as int) as rank
    from m order by m.score desc, id limit 10""")
def multi_query(t):
    hits = vector_topk_many(centroids(t), domain.vectors(t), 10)
    return rounded(fusion.best_per_id(hits.withColumn("qid", F.lit(0)), 10))


@query("a12_metrics", f"""with {_CENTROID},
    r as (select qid, id, label = qid as relevant, row_number() over (partition by qid order by score desc, id) as rk from hit),
    n as (select label as qid, count(*) as n from embeddings group by 1),
    m as (select n.qid, n.n, count(*) filter (where relevant) as f, max(case when relevant then 1e0 / rk end) as mrr,
                 sum(case when relevant then 1e0 / log2(rk + 1e0) else 0e0 end) as dcg from n left join r using (qid) group by all)
    select qid, round(f / 10e0, 6) as precision_at_k, round(f / n, 6) as recall_at_k, round(coalesce(mrr, 0), 6) as mrr,
           round(dcg / list_sum(list_transform(range(1, least(n, 10) + 1), lambda x: 1e0 / log2(x + 1e0))), 6) as ndcg_at_k from m""")
def metrics(t):
    hits = vector_topk_many(centroids(t), domain.vectors(t), 10)
    labels = t.embeddings.select(F.col("vec_id").alias("id"), "label")
    judged = hits.join(labels, "id").withColumn("relevant", F.col("label") == F.col("qid"))
    n_relevant = t.embeddings.groupBy(F.col("label").alias("qid")).agg(F.count(F.lit(1)).alias("n_relevant"))
    result = evaluation.retrieval_metrics(judged, n_relevant, 10)
    return result.select("qid", *[F.round(c, 6).alias(c) for c in result.columns[1:]])


@query("r13_self_check", f"""
    with first as (select label, min(vec_id) as qid from embeddings group by 1),
    s as (select f.qid, v.vec_id as id, round(list_dot_product(v.embedding::double[], q.embedding::double[]), 9) as score
          from first f join embeddings q on q.vec_id = f.qid, embeddings v)
    select qid, id, round(score, 6) as score, cast(1 as int) as rank from s
    qualify row_number() over (partition by qid order by s.score desc, id) = 1""")
def self_check(t):
    return rounded(ingest.self_check(domain.vectors(t), domain.vectors(t), "label"))


# Hits of the first vector joined to the chunks of their documents: a hit list with tender context.
_HITS = f"""with {_FIRST},
    top as (select v.vec_id, {_DOT} as score from embeddings v, q order by {_DOT} desc, vec_id limit 20),
    hits as (select 0 as qid, c.id, c.tender_code, c.text, c.section_type, c.chunk_index, top.score,
                    row_number() over (order by top.score desc, c.doc_id, c.chunk_index) as rank
             from top join v_chunk c on c.doc_id = top.vec_id),
    ctx as (select h.*, t.title as tender_title, t.buyer_name, t.base_amount, t.publication_date
            from hits h join v_tender t on t.code = h.tender_code),"""


def top_documents(t):
    return vector_topk(domain.vectors(t), first_vector(t), 20).select(F.col("id").alias("doc_id"), "score")


def hits_with_text(t):
    top = top_documents(t)
    ranked = F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "doc_id", "chunk_index"))
    hits = domain.chunks(t, only=top).join(top, "doc_id").withColumn("qid", F.lit(0))
    return hits.withColumn("rank", ranked).select(
        "qid", "id", "tender_code", "text", "section_type", "chunk_index", "score", "rank")


def hits_with_context(t):
    tenders = domain.tenders(t).select(
        F.col("code").alias("tender_code"), F.col("title").alias("tender_title"), "buyer_name", "base_amount", "publication_date")
    return hits_with_text(t).join(tenders, "tender_code")


@query("r4c_boost", _HITS + """
    b as (select id, round(score * (1 + case when publication_date >= date '1997-01-01' then 0.1e0 else 0e0 end
        + case when base_amount > 250000 then 0.05e0 else 0e0 end
        + case when section_type = 'requirements' then 0.15e0 else 0e0 end), 9) as score, rank as old_rank from ctx)
    select id, round(score, 6) as score, cast(row_number() over (order by b.score desc, old_rank) as int) as rank
    from b order by b.score desc, old_rank limit 10""", "v_tender v_chunk")
def boost(t):
    boosted = F.rint(fusion.metadata_boost(recent_from="1997-01-01", high_value=250000.0) * 1e9) / 1e9
    result = fusion.rerank(hits_with_context(t), 10, fusion.rescored(boosted))
    return rounded(result.select("id", "score", "rank"))


@query("r4b_overlap_rerank", _HITS + r"""
    b as (select id, rank as old_rank, round(len(list_intersect(['the', 'of', 'and', 'que', 'der'],
              regexp_split_to_array(lower(text), '[ \t\n\x0b\f\r]+'))) / 5e0, 6) as score from ctx)
    select id, score, cast(row_number() over (order by score desc, old_rank) as int) as rank from b order by rank limit 5""",
       "v_tender v_chunk")
def overlap_rerank(t):
    score = fusion.term_overlap(F.lit("The of AND que der"), "text")
    result = fusion.rerank(hits_with_context(t), 5, fusion.rescored(score))
    return rounded(result.select("id", "score", "rank"))


@query("r5_budget", _HITS + r"""
    n as (select id, rank, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) as n_tokens from hits),
    s as (select *, sum(n_tokens) over (order by rank) as tokens_so_far from n)
    select id, cast(rank as int) as rank, cast(n_tokens as int) as n_tokens, cast(tokens_so_far as bigint) as tokens_so_far from s where tokens_so_far <= 2000""",
       "v_tender v_chunk")
def budget(t):
    kept = fusion.within_budget(hits_with_text(t))
    return kept.select("id", "rank", "n_tokens", "tokens_so_far")


@query("t8_search_with_context", _HITS + """
    b as (select id, tender_code, round(score * (1 + case when publication_date >= date '1997-01-01' then 0.1e0 else 0e0 end
        + case when base_amount > 1000000 then 0.05e0 else 0e0 end
        + case when section_type = 'requirements' then 0.15e0 else 0e0 end), 6) as score, rank as old_rank from ctx)
    select id, tender_code, score from b order by b.score desc, old_rank limit 10""", "v_tender v_chunk")
def with_context(t):
    hits = hits_with_text(t).select("qid", "id", "score", "rank")
    links = domain.chunk_links(t, only=top_documents(t))
    found = retrieval.search_with_context(hits, links, domain.tenders(t), 10, "1997-01-01")
    return rounded(found.select("id", "tender_code", "score"))


@query("j6_enrich", _HITS + """
    e as (select h.id, t.title as tender_title, t.buyer_name, t.cpv_code from hits h join v_tender t on t.code = h.tender_code
          where t.status = 'open') select * from e""", "v_tender v_chunk")
def enriched(t):
    return _enriched(t, False)


@query("j6b_enrich_keep_all", _HITS + """
    e as (select h.id, t.title as tender_title, t.buyer_name, t.cpv_code from hits h
          left join v_tender t on t.code = h.tender_code and t.status = 'open') select * from e""", "v_tender v_chunk")
def enriched_all(t):
    return _enriched(t, True)


def _enriched(t, keep_all):
    hits = hits_with_text(t).select("id", "score")
    open_tenders = domain.tenders(t).filter("status = 'open'")
    context = graph.chunk_context(hits, domain.chunk_links(t, only=top_documents(t)), open_tenders)
    return retrieval.enrich(hits, context, keep_all).select("id", "tender_title", "buyer_name", "cpv_code")


@query("a10_context_order", _HITS + """
    f as (select id, tender_code, rank, min(rank) over (partition by tender_code) as first from hits)
    select id, tender_code, cast(dense_rank() over (order by first) as int) as tender_position,
           cast(row_number() over (order by first, rank) as int) as position from f""", "v_tender v_chunk")
def context_order(t):
    return fusion.group_by_tender(hits_with_text(t)).select("id", "tender_code", "tender_position", "position")


@query("x15_context_lines", _HITS + """
    f as (select *, min(rank) over (partition by tender_code) as first from ctx)
    select qid, cast(row_number() over (order by first, rank) as int) as position, tender_code,
           concat('TENDER: ', tender_title, ' | Buyer: ', buyer_name, ' | Amount: €',
                  format('{:,}', cast(round_even(base_amount, 0) as bigint))) as heading from f""", "v_tender v_chunk")
def context_lines(t):
    return retrieval.context_lines(hits_with_context(t)).drop("relevance")


@query("a8_confidence", _HITS + """
    c as (select qid, round(avg(score), 6) as confidence, count(*) as n_citations from hits group by 1) select * from c""",
       "v_tender v_chunk")
def confidence(t):
    return rounded(fusion.confidence(hits_with_text(t)), "confidence")


@query("r7_answer_context", _HITS + r"""
    n as (select *, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) as n_tokens from hits where rank <= 5),
    s as (select *, sum(n_tokens) over (order by rank) as so_far from n),
    c as (select qid, count(*) as n, string_agg(text, chr(10) || chr(10) order by rank) as context from s where so_far <= 500 group by 1)
    select cast(r_regionkey as int) as qid, r_name as question, coalesce(n, 0) as n_citations, md5(concat('CONTEXT:' || chr(10),
           coalesce(context, ''), chr(10) || chr(10) || 'QUESTION: ', r_name)) as answer
    from region left join c on qid = r_regionkey""", "v_tender v_chunk")
def answer_context(t):
    # region 0 asks for the first vector; the others find nothing and are answered all the same
    questions = t.region.select(F.col("r_regionkey").cast("int").alias("qid"), F.col("r_name").alias("question"))
    return retrieval.answer_context(
        hits_with_text(t), questions, k=5, max_tokens=500, generate=lambda p: F.md5(F.encode(p, "UTF-8")))


@query("r6_rewrite", r"""
    with q as (select item_id as qid, text as question,
            list_transform(range(64), lambda i: length(concat('Domanda: ', text)) / 1000.0e0 + i / 64.0e0) as v from benchmark),
    s as (select qid, vec_id as id, round(list_dot_product(embedding::double[], q.v), 9) as score from embeddings, q),
    top as (select qid, id, row_number() over (partition by qid order by s.score desc, id) as rank from s
            qualify row_number() over (partition by qid order by s.score desc, id) <= 3),
    n as (select qid, rank, text, len(list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) as n_tokens
          from top join documents on doc_id = id),
    b as (select *, sum(n_tokens) over (partition by qid order by rank) as so_far from n),
    c as (select qid, count(*) as n, string_agg(text, chr(10) || chr(10) order by rank) as context from b where so_far <= 300 group by 1)
    select q.qid, question, coalesce(n, 0) as n_citations,
           md5(concat('CONTEXT:' || chr(10), coalesce(context, ''), chr(10) || chr(10) || 'QUESTION: ', question)) as answer
    from q left join c on c.qid = q.qid""")
def rewrite(t):
    def rewritten(questions):
        return questions.withColumn("question", F.concat(F.lit("Domanda: "), "question"))

    def retrieve(questions):
        asked = questions.select("qid", length_embedding("question", 64).alias("query_vector"))
        hits = vector_topk_many(asked, domain.vectors(t), 3)
        return hits.join(t.documents.select(F.col("doc_id").alias("id"), "text"), "id")

    return retrieval.answer_questions(domain.questions(t), retrieve, rewritten, k=3, max_tokens=300,
                                      generate=lambda p: F.md5(F.encode(p, "UTF-8")))


@query("f21_citations", _HITS + """
    c as (select id, tender_code, section_type, cast(rank as int) as rank from hits where rank <= 5) select * from c""",
       "v_tender v_chunk")
def citation_rows(t):
    return hits_with_text(t).filter("rank <= 5").select("id", "tender_code", "section_type", "rank")


@query("r10_expand", _HITS + """
    lead as (select tender_code as code, min(rank) as first from hits group by 1 order by first, 1 limit 3),
    rel as (select a.code as source_code, b.code as tender_code,
                   case when substring(a.cpv_code, 1, 2) = substring(b.cpv_code, 1, 2) then 2 else 1 end as similarity_score,
                   b.publication_date from v_tender a join lead l on l.code = a.code join v_tender b on a.code <> b.code
             and (substring(a.cpv_code, 1, 2) = substring(b.cpv_code, 1, 2) or a.buyer_name = b.buyer_name)
             qualify row_number() over (partition by a.code order by similarity_score desc, b.publication_date desc nulls first, b.code) <= 30),
    few as (select tender_code, id, section_type from v_chunk where section_type = 'other'
            qualify row_number() over (partition by tender_code order by chunk_index, id) <= 3)
    select source_code, tender_code, similarity_score, few.id as chunk_id, section_type from rel join few using (tender_code)""",
       "v_tender v_chunk")
def expand(t):
    return retrieval.expand_by_related(hits_with_text(t), domain.tenders(t), domain.chunk_links(t), "other", n_related=30)


@query("r11_route", """
    select case when contains(lower(q), 'scadenza') or contains(lower(q), 'quando') or contains(lower(q), 'data') then 'graph_only'
                when contains(lower(q), 'requisiti') or contains(lower(q), 'obbligatorio') then 'graph_first'
                else 'vector_first' end as strategy, count(*) as n
    from (select case turn % 4 when 0 then text when 1 then concat('Quali REQUISITI ', text) when 2 then concat('Quando ', text)
                 else concat('requisiti e scadenza ', text) end as q from conversations) group by 1""")
def route(t):
    kind = F.col("turn") % 4
    question = (F.when(kind == 0, F.col("text")).when(kind == 1, F.concat(F.lit("Quali REQUISITI "), "text"))
                .when(kind == 2, F.concat(F.lit("Quando "), "text")).otherwise(F.concat(F.lit("requisiti e scadenza "), "text")))
    return t.conversations.groupBy(X.route(question).alias("strategy")).agg(F.count(F.lit(1)).alias("n"))


@query("r12_graph_first", """
    select l.tender_code, l.id as lot_id, r.id as requirement_id, c.id as chunk_id, md5(c.text) as digest
    from v_tender t join v_lot l on l.tender_code = t.code join v_requirement r on r.id = l.requirement_id
    join v_chunk c on c.tender_code = r.id where r.mandatory and t.code = '46'""",
       "v_tender v_lot v_requirement v_chunk")
def graph_first(t):
    stated = domain.chunk_links(t).select(F.col("tender_code").alias("requirement_id"), F.col("id").alias("chunk_id"))
    found = retrieval.graph_first(
        domain.tenders(t), domain.lots(t), domain.requirements(t), stated, domain.chunks(t), "46")
    return found.select("tender_code", "lot_id", "requirement_id", "chunk_id",
                        F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("r12_vector_first", _HITS + """
    m as (select h.id, h.tender_code, r.id as requirement_id from hits h left join v_requirement r on r.id = h.tender_code and r.mandatory)
    select * from m""", "v_tender v_chunk v_requirement")
def vector_first(t):
    stated = domain.chunk_links(t).select(F.col("tender_code").alias("requirement_id"), F.col("id").alias("chunk_id"))
    mandatory = domain.requirements(t).filter("mandatory").select(F.col("id").alias("requirement_id"))
    hits = hits_with_text(t).select("id", "tender_code")
    return retrieval.vector_first(hits, stated.join(mandatory, "requirement_id", "left_semi"))


@query("r12_routed", """
    with q as (select item_id as qid, cast(item_id as varchar) as tender_code,
                      case item_id % 3 when 0 then concat('Quando? ', text) when 1 then concat('Requisiti: ', text) else text end as question from benchmark),
    r as (select *, case when contains(lower(question), 'scadenza') or contains(lower(question), 'quando') or contains(lower(question), 'data') then 'graph_only'
                         when contains(lower(question), 'requisiti') or contains(lower(question), 'obbligatorio') then 'graph_first' else 'vector_first' end as route from q),
    dates as (select qid, route, 'deadline' as kind, cast(null as double) as score, concat_ws(' ', type, cast(date as varchar), notes) as id,
                     row_number() over (partition by qid order by date nulls last, type, notes) as rank
              from r join v_deadline d on d.tender_code = r.tender_code where route = 'graph_only'),
    stated as (select distinct qid, route, c.id from r join v_lot l on l.tender_code = r.tender_code join v_tender t on t.code = l.tender_code
               join v_requirement q on q.id = l.requirement_id and q.mandatory join v_chunk c on c.tender_code = q.id where route = 'graph_first'),
    near as (select qid, route, vec_id as id, round(list_dot_product(embedding::double[],
                    list_transform(range(64), lambda i: length(question) / 1000.0e0 + i / 64.0e0)), 9) as score from r, embeddings where route = 'vector_first'),
    hits as (select qid, route, rank, id, kind, score from dates where rank <= 4
        union all select qid, route, row_number() over (partition by qid order by id), id, 'chunk', null from stated
            qualify row_number() over (partition by qid order by id) <= 4
        union all select qid, route, row_number() over (partition by qid order by score desc, id), cast(id as varchar), 'vector', score from near
            qualify row_number() over (partition by qid order by score desc, id) <= 4)
    select qid, route, cast(rank as int) as rank, id, kind, round(score, 6) as score from hits""", "v_tender v_lot v_requirement v_deadline v_chunk")
def routed(t):
    asked = domain.questions(t).withColumn("question", F.when(F.col("qid") % 3 == 0, F.concat(F.lit("Quando? "), "question"))
                                           .when(F.col("qid") % 3 == 1, F.concat(F.lit("Requisiti: "), "question")).otherwise(F.col("question")))
    asked = asked.withColumn("tender_code", F.col("qid").cast("string")).withColumn("query_vector", length_embedding("question", 64))
    stated = domain.chunk_links(t).select(F.col("tender_code").alias("requirement_id"), F.col("id").alias("chunk_id"))
    return rounded(retrieval.routed_search(asked, {
        "graph_only": lambda q: retrieval.deadlines_of(q, domain.deadlines(t), 4),
        "graph_first": lambda q: retrieval.requirements_of(q, domain.tenders(t), domain.lots(t), domain.requirements(t), stated, 4),
        "vector_first": lambda q: retrieval.nearest_chunks(q, domain.vectors(t), 4)}))


@query("r3_hybrid_many", f"""with {_KEYWORD_HITS},
    q as (select item_id as qid, list_transform(range(64), lambda i: length(text) / 1000.0e0 + i / 64.0e0) as v from benchmark),
    s as (select qid, vec_id as id, round(list_dot_product(embedding::double[], q.v), 9) as score from embeddings, q),
    vec as (select qid, id, score, row_number() over (partition by qid order by s.score desc, id) as ord from s
            qualify row_number() over (partition by qid order by s.score desc, id) <= 5),
    kw as (select qid, id, 1000000 + row_number() over (partition by qid order by id) as ord
           from found qualify row_number() over (partition by qid order by id) <= 5),
    both_sides as (select qid, id, ord, 0.7e0 * score / max(score) over (partition by qid) as score from vec
                   union all select qid, id, ord, 1e0 - 0.7e0 from kw),
    best as (select qid, id, score, min(ord) over (partition by qid, id) as first from both_sides
             qualify row_number() over (partition by qid, id order by score desc, ord) = 1)
    select qid, id, round(score, 6) as score, cast(row_number() over (partition by qid order by best.score desc, first) as int) as rank
    from best qualify row_number() over (partition by qid order by best.score desc, first) <= 5""")
def hybrid_many(t):
    asked = domain.questions(t).select(
        "qid", F.col("question").alias("terms"), length_embedding("question", 64).alias("query_vector"))
    documents = domain.documents(t).withColumnRenamed("doc_id", "id")
    found = retrieval.hybrid_search_many(asked, domain.vectors(t), documents, 5)
    return rounded(found.select("qid", "id", "score", "rank"))
