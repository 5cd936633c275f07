"""Projections, predicates and scalar functions."""

from pyspark.sql import functions as F

from bidlake.functions import keywords as K
from bidlake.functions import text as X
from bidlake.functions import validation as V
from bidlake.functions.filters import matches, optional_equals
from bidlake.operators import graph, relational
from bidlake.operators.keyword import keyword_search, keyword_search_many
from bidlake.plans.catalogue.registry import query
from bidlake.sources import catalog, domain

TENDER = "code, title, cpv_code, base_amount, buyer_name, publication_date"


@query("f1_point", "select * from v_tender where code = '7'", "v_tender")
def point(t):
    return relational.point_lookup(domain.tenders(t, ["7"]), "code", "7")


@query("f2_tender_by_code", f"select {TENDER} from v_tender where code = '42'", "v_tender")
def by_code(t):
    return graph.tender_by_code(domain.tenders(t, ["42"]), "42")


@query("f3_optional_filters", "select doc_id, lang, source from documents where lang = 'en' order by doc_id limit 100")
def optional_filters(t):
    return relational.page(t.documents.select("doc_id", "lang", "source"), "doc_id", lang="en", source=None)


@query("f4_by_cpv", f"select {TENDER} from v_tender where starts_with(cpv_code, '72') order by publication_date desc nulls first, code limit 10", "v_tender")
def by_cpv(t):
    return graph.tenders_by_cpv(domain.tenders(t), "72")


@query("f5_by_buyer", """select code, title, buyer_name, base_amount, publication_date from v_tender
    where contains(lower(buyer_name), lower('CUSTOMER#00000001')) order by publication_date desc nulls first, code limit 10""", "v_tender")
def by_buyer(t):
    return graph.tenders_by_buyer(domain.tenders(t), "CUSTOMER#00000001")


@query("f8_keyword_predicate", r"""
    select lang, count(*) as n from documents where text like '%the%' and text like '%ing%' and text like '%t_on%' group by lang""")
def keyword_predicate(t):
    found = t.documents.filter(X.contains_all("text", X.query_terms(" the  ing t_on ")))
    return found.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("f9_match_all", "select cast(null as double) as score, doc_id, lang from documents order by doc_id limit 5")
def match_all(t):
    return keyword_search(t.documents, "   ", 5, "doc_id", output_fields=["lang"])


@query("f10_membership", "select doc_id, quality, toxic from labels semi join embeddings on doc_id = vec_id")
def membership(t):
    ids = t.embeddings.select(F.col("vec_id").alias("doc_id"))
    return t.labels.join(ids, "doc_id", "left_semi")


@query("f11_json_path", """
    select event_type, count(*) as n, round(sum(value), 2) as total from events
    where cast(json_extract_string(props, '$.k') as int) >= 50 group by event_type""")
def json_path(t):
    k = F.get_json_object("props", "$.k").try_cast("int")
    return t.events.filter(k >= 50).groupBy("event_type").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 2).alias("total"))


@query("f13_filter_document", """
    select code, status, base_amount from v_tender
    where status in ('open', 'closed') and base_amount >= 100000 and base_amount <= 300000 and publication_date >= date '1997-01-01'""",
       "v_tender")
def filter_document(t):
    spec = {"$and": [
        {"status": {"$in": ["open", "closed"]}},
        {"base_amount": {"$gte": 100000.0, "$lte": 300000.0}},
        {"publication_date": {"$gte": "1997-01-01"}},
    ]}
    return domain.tenders(t).filter(matches(spec)).select("code", "status", "base_amount")


@query("f16_boolean_keywords", """
    select doc_id, lang from documents where text like '%the%' and (text like '%of the%' or text like '%Und%') and not text like '%ting and%'""")
def boolean_keywords(t):
    condition = X.boolean_match("text", all_of=["the"], any_of=["of the", "Und"], none_of=["ting and"])
    return t.documents.filter(condition).select("doc_id", "lang")


_SYNTAX = ("the AND (\"of the\" OR Und) -ting", "que OR NOT the", "NOT (un OR der) AND en", "\"la \" OR le er")


@query("f16_syntax", """
    select qid, doc_id from documents, (values
        (0, 'the', 'of the', 'Und', 'ting'), (1, 'que', 'the', '', ''), (2, 'un', 'der', 'en', ''), (3, 'la ', 'le', 'er', '')) q(qid, a, b, c, d)
    where case qid when 0 then contains(text, a) and (contains(text, b) or contains(text, c)) and not contains(text, d)
        when 1 then contains(text, a) or not contains(text, b)
        when 2 then not (contains(text, a) or contains(text, b)) and contains(text, c)
        else contains(text, a) or (contains(text, b) and contains(text, c)) end""")
def syntax(t):
    asked = F.array(*[F.struct(F.lit(i).alias("qid"), K.postfix(q).alias("steps")) for i, q in enumerate(_SYNTAX)])
    met = F.filter("asked", lambda q: K.holds(F.col("text"), q["steps"]))
    return t.documents.select("doc_id", "text", asked.alias("asked")).select(F.explode(F.transform(met, lambda q: q["qid"])).alias("qid"), "doc_id")


@query("f16_batch_syntax", r"""
    with w as (select item_id as qid, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as w from benchmark),
    found as (select qid, doc_id as id from w, documents where contains(text, w[1]) and
        (contains(text, w[2]) or contains(text, concat(w[3], ' ', w[4]))) and not contains(text, w[5]))
    select qid, id, cast(row_number() over (partition by qid order by id) as int) as rank
    from found qualify row_number() over (partition by qid order by id) <= 25""")
def batch_syntax(t):
    """One boolean query per question, from its first words: all queries in one reading of the texts."""
    word = [F.get(X.tokens("text"), i) for i in range(5)]
    asked = t.benchmark.select(F.col("item_id").alias("qid"), F.concat(
        word[0], F.lit(" ("), word[1], F.lit(' OR "'), word[2], F.lit(" "), word[3], F.lit('") -'), word[4]).alias("terms"))
    return keyword_search_many(asked, domain.documents(t).withColumnRenamed("doc_id", "id"), 25, syntax=True)


@query("f17_timeline", """
    select code, title, publication_date as date, base_amount as amount, buyer_name as buyer from v_tender
    where starts_with(cpv_code, '1') and publication_date between date '1996-01-01' and date '1998-12-31'""", "v_tender")
def timeline(t):
    return graph.timeline(domain.tenders(t, published=("1996-01-01", "1998-12-31")), "1", "1996-01-01", "1998-12-31")


@query("f18_search_tenders", """
    select code, title, status, base_amount from v_tender where status = 'open'
    and (title ilike '%order 1%' or buyer_name ilike '%order 1%' or code ilike '%order 1%') and base_amount <= 250000
    order by code limit 100""", "v_tender")
def search_tenders(t):
    found = relational.search_tenders(
        domain.tenders(t), "order 1", "open", min_budget=0, max_budget=250000.0,
        text_columns=("title", "buyer_name", "code"))
    return found.select("code", "title", "status", "base_amount")


@query("f19_result_record", """
    select cast(null as double) as score, id, text, section_type, lang from v_chunk where text like '%the%' order by id limit 10""",
       "v_chunk")
def result_record(t):
    return keyword_search(domain.chunks(t), "the", 10, output_fields=["text", "section_type", "lang"])


@query("f20_serialised", """
    select event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') as ts, event_type from events""")
def serialised(t):
    return catalog.serialised(t.events.select("event_id", F.date_trunc("second", "ts").alias("ts"), "event_type"))


@query("f22_vector_display", """
    select vec_id, cast(len(embedding) as int) as dim, round(cast(embedding[5] as double), 6) as fifth from embeddings""")
def vector_display(t):
    shown = F.slice("embedding", 1, 5)
    return t.embeddings.select(
        "vec_id", F.size("embedding").alias("dim"),
        F.round(F.get(shown, F.lit(4)).cast("double"), 6).alias("fifth"))


@query("f24_upload_check", """
    select case when suffix not in ('.pdf', '.docx') then concat('Unsupported file type: ', suffix)
                when n_chars = 0 then 'Uploaded file is empty' when n_chars > 52428800 then 'File too large' end as error,
           count(*) as n
    from (select n_chars, case lang when 'en' then '.pdf' when 'fr' then '.docx' else '.odt' end as suffix from documents)
    group by 1""")
def upload_check(t):
    suffix = F.when(F.col("lang") == "en", ".PDF").when(F.col("lang") == "fr", ".docx").otherwise(".odt")
    files = t.documents.select(F.concat(F.lit("d."), F.col("doc_id").cast("string"), suffix).alias("filename"), "n_chars")
    return files.groupBy(V.upload_error("filename", "n_chars").alias("error")).agg(F.count(F.lit(1)).alias("n"))


@query("x1_cpv_division", "select substring(cpv_code, 1, 2) as division, count(*) as n from v_tender group by 1", "v_tender")
def cpv_division(t):
    return domain.cpv_classes(t).groupBy(F.col("cpv_division").alias("division")).agg(F.count(F.lit(1)).alias("n"))


@query("x5_date_text", """
    select strftime(publication_date, '%Y-%m-%d') as day, count(*) as n from v_tender group by 1""", "v_tender")
def date_text(t):
    return domain.tenders(t).groupBy(F.date_format("publication_date", "yyyy-MM-dd").alias("day")).agg(
        F.count(F.lit(1)).alias("n"))


@query("x8_first_truthy", """
    select coalesce(nullif(case when lang = 'en' then '' when lang = 'fr' then null else lang end, ''), source) as key,
           count(*) as n from documents group by 1""")
def first_truthy(t):
    maybe = F.when(F.col("lang") == "en", "").when(F.col("lang") == "fr", None).otherwise(F.col("lang"))
    return t.documents.groupBy(X.first_truthy(maybe, "source").alias("key")).agg(F.count(F.lit(1)).alias("n"))


@query("x10_list_functions", """
    select order_size, count(*) as n from (
        select tender_code, count(distinct requirement_id) as order_size from v_lot group by 1)
    where order_size in (1, 2, 3, 4) group by 1""", "v_lot")
def list_functions(t):
    sizes = domain.lots(t).select("tender_code", "requirement_id").distinct().groupBy("tender_code").agg(
        F.count(F.lit(1)).alias("order_size"))
    return sizes.filter(F.col("order_size").isin(1, 2, 3, 4)).groupBy("order_size").agg(F.count(F.lit(1)).alias("n"))


@query("x11_stable_id", "select doc_id, sha256(concat_ws(chr(31), source, cast(doc_id as varchar))) as id from documents")
def stable_id(t):
    return t.documents.select("doc_id", X.stable_id("source", F.col("doc_id").cast("string")).alias("id"))


@query("x12_file_suffix", """
    select lower(regexp_extract(url, '\\.[^./?#]*$')) as suffix, count(*) as n
    from (select regexp_replace(url, '[?#].*$', '') as url from pages) group by 1""".replace("\\\\", "\\"))
def file_suffix(t):
    path = F.regexp_replace("url", "[?#].*$", "")
    return t.pages.groupBy(X.file_suffix(path).alias("suffix")).agg(F.count(F.lit(1)).alias("n"))


@query("x13_cig_format", """
    select code, lpad(code, 10, '0') as cig, regexp_full_match(lpad(code, 10, '0'), '[0-9]{10}') as padded_ok,
           regexp_full_match(code, '[0-9]{10}') as code_ok from v_tender""", "v_tender")
def cig_format(t):
    padded = F.lpad("code", 10, "0")
    return domain.tenders(t).select(
        "code", padded.alias("cig"), V.is_cig(padded).alias("padded_ok"), V.is_cig("code").alias("code_ok"))


@query("x14_status_domain", """
    select status, status in ('draft', 'published', 'open', 'closed', 'awarded', 'cancelled') as valid, count(*) as n
    from (select o_orderstatus as status from orders union all select status from v_tender) group by all""", "v_tender")
def status_domain(t):
    both = t.orders.select(F.col("o_orderstatus").alias("status")).unionByName(domain.tenders(t).select("status"))
    return both.groupBy("status", V.is_tender_status("status").alias("valid")).agg(F.count(F.lit(1)).alias("n"))


@query("x15_formatting", """
    select code, concat('€', format('{:,}', cast(round(base_amount) as bigint))) as amount from v_tender""", "v_tender")
def formatting(t):
    return domain.tenders(t).select("code", F.concat(F.lit("€"), F.format_number(F.round("base_amount"), 0)).alias("amount"))


@query("f3_equality_set", """
    select source, lang, count(*) as n from documents where source = 'src7' and lang = 'en' group by all""")
def equality_set(t):
    return t.documents.filter(optional_equals(source="src7", lang="en", doc_id=0)).groupBy("source", "lang").agg(
        F.count(F.lit(1)).alias("n"))
