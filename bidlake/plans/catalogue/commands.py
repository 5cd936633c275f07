"""Commands, each as the table it leaves behind."""

from pyspark.sql import functions as F

from bidlake.operators import counted_writes, graph, relational
from bidlake.plans.catalogue.registry import query
from bidlake.sources import domain


def _tender_rows(t):
    return domain.tenders(t).select(F.col("code").alias("id"), "title", "status", "base_amount")


@query("c1_insert", """
    select id, title, status, base_amount from (select code as id, title, status, base_amount from v_tender
    union all select concat('S', s_suppkey), s_name, 'draft', null from supplier)""", "v_tender")
def insert(t):
    rows = t.supplier.select(
        F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"), F.col("s_name").alias("title"),
        F.lit("draft").alias("status"))
    return relational.insert(_tender_rows(t), rows)


@query("c2_document_rows", """
    select sha256(concat_ws(chr(31), source, '', concat(doc_id, '.pdf'))) as id, source as tender_id,
           cast(null as varchar) as lot_id, concat(doc_id, '.pdf') as filename, 'documents' as storage_bucket,
           concat(source, '/', sha256(concat_ws(chr(31), source, '', concat(doc_id, '.pdf'))), '_', doc_id, '.pdf') as storage_path
    from documents""")
def document_rows(t):
    rows = t.documents.select(
        F.col("source").alias("tender_id"), F.lit(None).cast("string").alias("lot_id"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".pdf")).alias("filename"))
    return relational.document_rows(rows, "documents")


@query("c2_repeated_uploads", """
    with up as (select cast(l_orderkey as varchar) as tender_id,
        sha256(concat_ws(chr(31), l_orderkey, '', 'offer.pdf', concat_ws('/', l_linenumber, l_partkey, l_suppkey))) as id from lineitem)
    select id, tender_id, concat(tender_id, '/', id, '_offer.pdf') as storage_path from up""")
def repeated_uploads(t):
    rows = t.lineitem.select(
        F.col("l_orderkey").cast("string").alias("tender_id"), F.lit(None).cast("string").alias("lot_id"),
        F.lit("offer.pdf").alias("filename"), F.concat_ws("/", "l_linenumber", "l_partkey", "l_suppkey").alias("upload"))
    return relational.document_rows(rows, "documents", "upload").select("id", "tender_id", "storage_path")


@query("c3_delete", """
    select id, title, status, base_amount from (select code as id, title, status, base_amount from v_tender)
    where id not in (select distinct cast(doc_id as varchar) from labels where toxic = 1)""", "v_tender")
def delete(t):
    return relational.delete(_tender_rows(t), t.labels.filter("toxic = 1").select(F.col("doc_id").cast("string").alias("id")))


@query("c3_delete_cascade", """
    with gone as (select code from v_tender where status = 'closed')
    select 'tenders' as kind, count(*) as n from v_tender where code not in (select code from gone)
    union all select 'lots', count(*) from v_lot where tender_code not in (select code from gone)
    union all select 'documents', count(*) from documents where cast(doc_id as varchar) not in (select code from gone)""",
       "v_tender v_lot")
def delete_cascade(t):
    tenders = _tender_rows(t)
    lots = domain.lots(t).select("id", F.col("tender_code").alias("tender_id"))
    documents = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("tender_id"))
    left = relational.delete_tenders(tenders, lots, documents, tenders.filter("status = 'closed'"))
    kinds = zip(("tenders", "lots", "documents"), left)
    parts = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(k).alias("kind"), "n") for k, df in kinds]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query("j14_set_null", """
    select doc_id, case when lot_id in (select id from v_lot where tender_code in
           (select code from v_tender where status = 'closed')) then null else lot_id end as lot_id
    from (select d.doc_id, m.id as lot_id from documents d
          left join (select tender_code, min(id) as id from v_lot group by 1) m on m.tender_code = cast(d.doc_id as varchar))""",
       "v_tender v_lot")
def set_null(t):
    lots = domain.lots(t)
    first = lots.groupBy("tender_code").agg(F.min("id").alias("lot_id"))
    documents = t.documents.select("doc_id", F.col("doc_id").cast("string").alias("tender_code")).join(
        first, "tender_code", "left").select("doc_id", "lot_id")
    closed = domain.tenders(t).filter("status = 'closed'").select(F.col("code").alias("tender_code"))
    _, updated = relational.delete_lots(lots, documents, lots.join(closed, "tender_code", "left_semi"))
    return updated


@query("c4_partial_update", """
    select t.code as id, case when p.code is null or p.k = 0 then t.title else p.title end as title,
           case when p.code is null or p.k = 1 then t.status else null end as status, t.base_amount
    from v_tender t left join (
        select cast(doc_id as varchar) as code, concat('Document ', doc_id) as title, quality as k from labels) p on p.code = t.code""",
       "v_tender")
def partial_update(t):
    # quality 1 sets the title; quality 0 sets the status to null and must leave the title alone
    patches = t.labels.select(
        F.col("doc_id").cast("string").alias("id"),
        F.concat(F.lit("Document "), F.col("doc_id").cast("string")).alias("title"),
        F.lit(None).cast("string").alias("status"),
        F.when(F.col("quality") == 1, F.array(F.lit("title"))).otherwise(F.array(F.lit("status"))).alias("set_fields"))
    return relational.partial_update(_tender_rows(t), patches)


@query("c5_upsert", """
    with base as (select cast(p_partkey as varchar) as id, p_retailprice as price, cast(null as bigint) as ord from part),
    incoming as (select cast(l_partkey as varchar) as id, l_extendedprice as price,
                        l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey as ord from lineitem),
    last as (select * from incoming qualify row_number() over (partition by id order by ord desc, price desc) = 1)
    select id, price from base where id not in (select id from last) union all select id, price from last""")
def upsert(t):
    base = t.part.select(F.col("p_partkey").cast("string").alias("id"), F.col("p_retailprice").alias("price"))
    rows = t.lineitem.select(
        F.col("l_partkey").cast("string").alias("id"), F.col("l_extendedprice").alias("price"),
        F.struct(F.expr("l_orderkey * 1000000 + l_linenumber * 100000 + l_suppkey").alias("a"),
                 F.col("l_extendedprice").alias("b")).alias("ord"))
    return relational.upsert(base, rows, "id", "ord")


@query("c6_create_tender", """
    select code, title, cpv_code, base_amount, buyer_name, publication_date from v_tender
    union all select concat('N', s_suppkey), s_name, lpad(cast(s_suppkey as varchar), 8, '0'), s_acctbal, s_name, date '2025-01-15'
    from supplier""", "v_tender")
def create_tender(t):
    new = t.supplier.select(
        F.concat(F.lit("N"), F.col("s_suppkey").cast("string")).alias("code"), F.col("s_name").alias("title"),
        F.lpad(F.col("s_suppkey").cast("string"), 8, "0").alias("cpv_code"), F.col("s_acctbal").alias("base_amount"),
        F.col("s_name").alias("buyer_name"), F.lit("2025-01-15").alias("publication_date"), F.lit("x").alias("extra"))
    return graph.create_tenders(domain.tenders(t).select(*graph.TENDER_COLUMNS), new)


@query("c7_add_lots", """
    select id, tender_code, base_amount from v_lot
    union all select concat('new-', vec_id), cast(vec_id * 100 as varchar), cast(label as double) from embeddings
    where cast(vec_id * 100 as varchar) in (select code from v_tender)""", "v_tender v_lot")
def add_lots(t):
    new = t.embeddings.select(
        F.concat(F.lit("new-"), F.col("vec_id").cast("string")).alias("id"),
        (F.col("vec_id") * 100).cast("string").alias("tender_code"), F.col("label").cast("double").alias("base_amount"))
    return graph.add_lots(domain.lots(t).select("id", "tender_code", "base_amount"), new, domain.tenders(t))


@query("c8_chunk_vertices", """
    select id, tender_code, coalesce(substring(text, 1, 200), '') as text_preview, 0 as page_number, chunk_index
    from v_chunk where tender_code in (select code from v_tender)""", "v_tender v_chunk")
def chunk_vertices(t):
    chunks = domain.chunks(t).withColumn(
        "metadata", F.create_map(F.lit("chunk_index"), F.col("chunk_index").cast("string")))
    return graph.chunk_vertices(chunks, domain.tenders(t))


@query("c10_write_counters", """
    select (select count(*) from supplier) as created,
           (select count(*) from v_tender where status = 'published') as deleted,
           (select count(*) from v_tender where status = 'open') as changed""", "v_tender")
def write_counters(t):
    before = _tender_rows(t)
    rows = t.supplier.select(F.concat(F.lit("S"), F.col("s_suppkey").cast("string")).alias("id"),
                             F.col("s_name").alias("title"))
    after = relational.insert(before.filter("status <> 'published'"), rows)
    after = after.withColumn("title", F.when(F.col("status") == "open", F.upper("title")).otherwise(F.col("title")))
    return graph.write_counters(before, after, "id")


@query("c10_graph_counters", """
    with made as (select count(*) as n from supplier), o as (select * from v_tender where status = 'open'),
    gone as (select count(distinct t.code) as n, count(l.id) as lots from v_tender t left join v_lot l on l.tender_code = t.code where status = 'published')
    select made.n as nodes_created, gone.n as nodes_deleted, made.n as relationships_created, gone.lots as relationships_deleted,
           -- code and title of a new tender, key and both ends of a new edge less the key itself, title of an open one
           2 * made.n + 2 * made.n + (select count(*) from o) as properties_set from made, gone""", "v_tender v_lot")
def graph_counters(t):
    """One write of tenders and their lots; the sink discards the rows, the counters come from the write."""
    tenders = domain.tenders(t)
    code = F.concat(F.lit("S"), F.col("s_suppkey").cast("string"))
    merged = t.supplier.select(code.alias("code"), F.col("s_name").alias("title")).unionByName(
        tenders.filter("status = 'open'").select("code", F.upper("title").alias("title")))
    deleted = tenders.filter("status = 'published'").select("code")
    edges = domain.lots(t).select("id", "tender_code")
    totals = counted_writes.write_counted({
        "Tender": counted_writes.Change(tenders, "code", merged, deleted),
        "HAS_LOT": counted_writes.Change(edges, "id", t.supplier.select(F.concat(F.lit("L"), code).alias("id"), code.alias("tender_code")),
                                         detach=("tender_code", deleted), relationship=True),
    }, lambda rows, name: rows.write.format("noop").mode("overwrite").save())
    return t.spark.createDataFrame([tuple(totals.values())], ", ".join(f"{c} long" for c in totals))


@query("c12_detach_delete", """
    select case when t.status = 'closed' then null else l.tender_code end as tender_code, count(*) as n
    from v_lot l join v_tender t on t.code = l.tender_code group by 1""", "v_tender v_lot")
def detach_delete(t):
    tenders = domain.tenders(t)
    _, left = graph.detach_delete(
        tenders, {"Lot": domain.lots(t).select("id", "tender_code")}, tenders.filter("status = 'closed'"))
    return left["Lot"].groupBy("tender_code").agg(F.count(F.lit(1)).alias("n"))


@query("a15_duplicates", "select lot_code, count(*) as n from v_lot group by 1 having count(*) > 1", "v_lot")
def duplicates(t):
    return graph.constraint_violations(domain.lots(t), "lot_code")
