"""Graph and portfolio aggregates."""

from pyspark.sql import functions as F

from bidlake.functions.vectors import mean_vector
from bidlake.operators import evaluation, graph, workflows
from bidlake.plans.catalogue.joins import checklist_inputs
from bidlake.plans.catalogue.registry import query
from bidlake.sources import domain


@query("a2_label_counts", """
    select 'nodes_Tender' as stat, count(*) as n from v_tender union all select 'nodes_Lot', count(*) from v_lot
    union all select 'nodes_Chunk', count(*) from v_chunk union all select 'nodes_Requirement', count(*) from part
    union all select 'nodes_Organization', count(*) from customer
    union all select 'relationships_total', (select count(*) from v_lot) + (select count(*) from v_chunk)""",
       "v_tender v_lot v_chunk")
def label_counts(t):
    lots, chunks = domain.lots(t), domain.chunk_links(t)
    return graph.label_counts(
        {"Tender": domain.tenders(t), "Lot": lots, "Chunk": chunks, "Requirement": domain.requirements(t),
         "Organization": domain.organizations(t)},
        {"HAS_LOT": lots, "HAS_CHUNK": chunks})


@query("a3_top_by_chunks", """
    select t.code, t.title, count(c.id) as chunk_count from v_tender t left join v_chunk c on c.tender_code = t.code
    group by all order by chunk_count desc, t.code limit 10""", "v_tender v_chunk")
def top_by_chunks(t):
    return graph.top_by_chunks(domain.tenders(t), domain.chunk_links(t))


@query("j8_chunks_per_tender", """
    select t.code, count(c.id) as chunk_count from v_tender t left join v_chunk c on c.tender_code = t.code group by all""",
       "v_tender v_chunk")
def chunks_per_tender(t):
    counts = graph.chunk_counts(domain.chunk_links(t)).withColumnRenamed("tender_code", "code")
    return domain.tenders(t).select("code").join(counts, "code", "left").select(
        "code", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))


@query("a5_common_texts", """
    with pairs as (select distinct substring(text, 1, 200) as requirement_text, tender_code from v_chunk
                   where section_type = 'other'),
    top as (select requirement_text, count(*) as frequency from pairs group by 1 having count(*) >= 2
            order by frequency desc, requirement_text limit 10)
    select p.requirement_text, frequency, tender_code from pairs p join top using (requirement_text)""", "v_chunk")
def common_texts(t):
    return graph.common_texts(domain.chunks(t), section="other")


@query("a6_portfolio", """
    with c as (select tender_code, count(*) as n from v_chunk group by 1)
    select buyer_name as buyer, count(*) as total_tenders, round(sum(base_amount), 2) as total_budget,
           count(distinct cpv_code) as n_cpv_codes, cast(coalesce(sum(n), 0) as bigint) as total_chunks
    from v_tender left join c on c.tender_code = code where contains(lower(buyer_name), 'customer') group by 1""",
       "v_tender v_chunk")
def portfolio(t):
    result = graph.buyer_portfolio(domain.tenders(t), domain.chunk_links(t), "CUSTOMER")
    return result.withColumn("total_budget", F.round("total_budget", 2))


@query("a6_portfolio_cpv", """
    select distinct buyer_name as buyer, cpv_code from v_tender where contains(lower(buyer_name), '#00000')""", "v_tender")
def portfolio_cpv(t):
    return graph.portfolio_cpv_codes(domain.tenders(t), "#00000")


@query("a7_section_hist", "select section_type as section, count(*) as chunk_count from v_chunk group by 1", "v_chunk")
def section_hist(t):
    return graph.section_histogram(domain.chunk_links(t))


@query("a9_health", """
    select (select count(*) from v_tender) as total_tenders, count(*) as total_chunks,
           count(*) filter (where tender_code not in (select code from v_tender)) as orphaned_chunks,
           round(count(*) / greatest((select count(*) from v_tender), 1), 6) as avg_chunks_per_tender from v_chunk""",
       "v_tender v_chunk")
def health(t):
    result = graph.index_health(domain.tenders(t), domain.chunk_links(t))
    return result.withColumn("avg_chunks_per_tender", F.round("avg_chunks_per_tender", 6))


@query("a11_mean_vectors", """
    select label, cast(i - 1 as int) as position, round(avg(cast(embedding[i] as double)), 6) as mean
    from embeddings, range(1, 65) r(i) group by all""")
def mean_vectors(t):
    means = t.embeddings.groupBy("label").agg(mean_vector("embedding", 64).alias("v"))
    return means.select("label", F.posexplode("v").alias("position", "mean")).withColumn("mean", F.round("mean", 6))


@query("a13_checklist_summary", """
    with items as (select distinct l.tender_code, r.id as requirement_id from v_lot l join v_requirement r on r.id = l.requirement_id
                   where r.mandatory),
    status as (select i.tender_code, case when p_partkey is null then 'unclear' when p_retailprice < 1000 then 'compliant'
                      else 'non_compliant' end as status
               from items i left join part on cast(p_partkey as varchar) = requirement_id and p_size < 40),
    counted as (select tender_code, count(*) as total_requirements, count(*) filter (where status = 'compliant') as compliant,
                       count(*) filter (where status = 'non_compliant') as non_compliant,
                       count(*) filter (where status = 'unclear') as unclear from status group by 1)
    select *, case when non_compliant > 0 then 'NO-GO' when unclear > 0 then 'EVALUATE' else 'GO' end as recommendation
    from counted""", "v_lot v_requirement")
def checklist_summary(t):
    return workflows.checklist_summary(workflows.checklist(*checklist_inputs(t)))


@query("a17_embedding_quality", """
    with u as (select vec_id, i, cast(embedding[i] as double) / sqrt(list_sum(list_transform(embedding, lambda x: cast(x as double) * x))) as x
               from embeddings, range(1, 65) r(i)),
    s as (select i, sum(x) as x from u group by 1)
    select (select count(*) from embeddings) as total, (select count(*) from embeddings where len(embedding) = 64) as valid_count,
           round((sum(x * x) - (select count(*) from embeddings)) /
                 ((select count(*) from embeddings) * ((select count(*) from embeddings) - 1.0)), 6) as avg_similarity from s""")
def embedding_quality(t):
    return evaluation.embedding_quality(t.embeddings, 64).withColumn("avg_similarity", F.round("avg_similarity", 6))


@query("t9_deadlines", """
    select type, date, notes from v_deadline where tender_code = '5979' order by date nulls last, type, notes""", "v_deadline")
def deadlines(t):
    return graph.tender_deadlines(domain.deadlines(t, ["5979"]), "5979")
