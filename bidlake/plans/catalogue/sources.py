"""Scans, catalog and paging queries."""

from pyspark.sql import functions as F

from bidlake.operators import graph, relational
from bidlake.plans.catalogue.registry import query
from bidlake.sources import catalog, domain
from bidlake.sources.tables import Tables


@query("s1_scan_documents", "select doc_id, lang, source, n_chars from documents")
def scan_documents(t):
    return t.documents.select("doc_id", "lang", "source", "n_chars")


@query("s2_label_scan", "select code, title, cpv_code, base_amount, buyer_name, publication_date from v_tender", "v_tender")
def label_scan(t):
    return domain.tenders(t).select(*graph.TENDER_COLUMNS)


@query("s3_edge_scan", """
    select type, count(*) as n_edges, min(src) as first_src, max(dst) as last_dst from (
        select 'HAS_LOT' as type, tender_code as src, id as dst from v_lot
        union all select 'REQUIRES', id, requirement_id from v_lot
        union all select 'HAS_CHUNK', tender_code, id from v_chunk
        union all select 'ISSUED_BY', code, buyer_name from v_tender
        union all select 'RELATED_TO', src, dst from v_related) group by type""",
       "v_tender v_lot v_chunk v_related")
def edge_scan(t):
    lots, tenders = domain.lots(t), domain.tenders(t)
    edges = graph.edge_scan({
        "HAS_LOT": lots.select(F.col("tender_code").alias("src"), F.col("id").alias("dst")),
        "REQUIRES": lots.select(F.col("id").alias("src"), F.col("requirement_id").alias("dst")),
        "HAS_CHUNK": domain.chunk_links(t).select(F.col("tender_code").alias("src"), F.col("id").alias("dst")),
        "ISSUED_BY": tenders.select(F.col("code").alias("src"), F.col("buyer_name").alias("dst")),
        "RELATED_TO": domain.related_requirements(t),
    })
    return edges.groupBy("type").agg(
        F.count(F.lit(1)).alias("n_edges"), F.min("src").alias("first_src"), F.max("dst").alias("last_dst"))


@query("s4_collection_fields", "select vec_id, label from embeddings order by vec_id limit 100")
def collection_fields(t):
    return catalog.collection_rows(t.embeddings, "vec_id", "vec_id, label", 100)


@query("s5_collection_preview", """
    select vec_id, array_to_string(list_transform(embedding[1:5], lambda x: cast(cast(round(cast(x as double) * 1e6) as bigint) as varchar)), ' ')
           as embedding, label from embeddings order by vec_id limit 20""")
def collection_preview(t):
    shown = catalog.preview_rows(t.embeddings, "vec_id", 20)
    return shown.withColumn("embedding", F.array_join(F.transform(
        "embedding", lambda x: F.round(x.cast("double") * 1e6).cast("bigint").cast("string")), " "))


@query("s6_list_collections", " union all ".join(
    f"select '{n}' as name, count(*) as row_count from {n}" for n in Tables.NAMES))
def list_collections(t):
    return catalog.list_collections({n: getattr(t, n) for n in Tables.NAMES})


@query("s7_describe_collection", """
    select c.name, c.type, (select count(*) from documents) as row_count
    from (values ('doc_id', 'bigint'), ('text', 'string'), ('lang', 'string'), ('source', 'string'),
                 ('n_chars', 'bigint')) c(name, type)""")
def describe_collection(t):
    documents = t.documents
    total = documents.agg(F.count(F.lit(1)).alias("n")).scalar()
    return catalog.describe(documents).select("name", "type", total.alias("row_count"))


@query("s13_blob_paths", """
    select doc_id, concat_ws('/', source, lang, concat(sha256(concat_ws(chr(31), source, lang, concat('doc_', doc_id, '.pdf'))),
           '_doc_', doc_id, '.pdf')) as storage_path from documents""")
def blob_paths(t):
    rows = t.documents.select(
        "doc_id", F.col("source").alias("tender_id"), F.col("lang").alias("lot_id"),
        F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return relational.document_rows(rows, "documents").select("doc_id", "storage_path")


@query("t1_page", "select code, title, status from v_tender order by code limit 100 offset 200", "v_tender")
def page(t):
    return relational.page(domain.tenders(t).select("code", "title", "status"), "code", offset=200)


@query("t5_keyword_limit", """
    select cast(null as double) as score, doc_id, lang from documents where text like '%the%' order by doc_id limit 20""")
def keyword_limit(t):
    from bidlake.operators.keyword import keyword_search

    return keyword_search(t.documents, "the", 20, "doc_id", output_fields=["lang"])


@query("a18_page_envelope", """
    select code, title, status, (select count(*) from v_tender where status = 'open') as total
    from v_tender where status = 'open' order by code limit 50""", "v_tender")
def page_envelope(t):
    return relational.page_with_total(
        domain.tenders(t).select("code", "title", "status"), "code", limit=50, status="open")
