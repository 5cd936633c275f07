"""Business rules over whole tables."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from bidlake.operators import clauses, graph, workflows
from bidlake.plans.catalogue.registry import query
from bidlake.sources import domain


@query("a14_bid_score", """
    with f as (
        select l.tender_code, 100.0e0 * avg(case when r.mandatory then 0 else 1 end) as compliance,
               least(100.0e0, 10.0e0 * count(*)) as timeline, 100.0e0 - least(100.0e0, avg(p_size)) as penalty,
               least(100.0e0, cast(max(p_size) * 2 as double)) as criteria, 50.0e0 as competition,
               least(100.0e0, min(p_size) * 5.0e0) as profitability
        from v_lot l join v_requirement r on r.id = l.requirement_id join part on cast(p_partkey as varchar) = r.id group by 1),
    s as (select tender_code, round(compliance * 0.35e0 + timeline * 0.15e0 + penalty * 0.10e0 + criteria * 0.20e0
                 + competition * 0.10e0 + profitability * 0.10e0, 6) as overall_score, compliance from f)
    select tender_code, overall_score, case when overall_score > 70 and compliance > 80 then 'GO'
           when overall_score < 40 or compliance < 50 then 'NO-GO' else 'EVALUATE' end as recommendation from s""",
       "v_lot v_requirement")
def bid_score(t):
    size = F.col("p_size")
    parts = t.part.select(F.col("p_partkey").cast("string").alias("requirement_id"), "p_size")
    cap = F.lit(100.0)
    factors = domain.lots(t).join(parts, "requirement_id").groupBy("tender_code").agg(
        (F.avg(F.when(size >= 25, 0.0).otherwise(1.0)) * 100.0).alias("compliance"),
        F.least(cap, F.count(F.lit(1)) * 10.0).alias("timeline"),
        (cap - F.least(cap, F.avg("p_size"))).alias("penalty"),
        F.least(cap, F.max(size) * 2.0).alias("criteria"),
        F.lit(50.0).alias("competition"),
        F.least(cap, F.min(size) * 5.0).alias("profitability"))
    return workflows.bid_score(factors).select("tender_code", "overall_score", "recommendation")


@query("a16_budget_check", """
    select code, t.base_amount, count(*) as lot_count, round(sum(l.base_amount), 2) as total_lots_amount,
           round(sum(l.base_amount) - t.base_amount, 2) as excess
    from v_tender t join v_lot l on l.tender_code = t.code group by code, t.base_amount
    having round(sum(l.base_amount), 2) > t.base_amount""", "v_tender v_lot")
def budget_check(t):
    totals = graph.lot_totals(domain.lots(t)).withColumn("total_lots_amount", F.round("total_lots_amount", 2))
    return workflows.budget_check(domain.tenders(t), totals).withColumn("excess", F.round("excess", 2))


@query("u3_change_detection", """
    with n as (select requirement_id, status, count(*) as n_lots, max(name) as last_lot from v_lot join v_tender on code = tender_code
               where status in ('open', 'closed') group by all),
    o as (select * from n where status = 'closed'), w as (select * from n where status = 'open')
    select coalesce(o.requirement_id, w.requirement_id) as requirement_id,
           case when o.requirement_id is null then 'added' when w.requirement_id is null then 'removed' else 'modified' end as change,
           o.n_lots as old_n_lots, o.last_lot as old_last_lot, w.n_lots as new_n_lots, w.last_lot as new_last_lot
    from o full join w on o.requirement_id = w.requirement_id
    where o.requirement_id is null or w.requirement_id is null or o.n_lots <> w.n_lots or o.last_lot <> w.last_lot""",
       "v_tender v_lot")
def change_detection(t):
    by_state = domain.tenders(t).select(F.col("code").alias("tender_code"), "status")
    named = domain.lots(t).join(by_state, "tender_code")
    editions = named.filter(F.col("status").isin("closed", "open")).groupBy("requirement_id", "status").agg(
        F.count(F.lit(1)).alias("n_lots"), F.max("name").alias("last_lot"))
    return workflows.change_set_in_one(editions, "requirement_id", "status", "closed", "open", ["n_lots", "last_lot"])


# Two versions of every document: the second drops, edits, moves and adds numbered clauses.
@query("u3_clauses", r"""
    with recursive split as (select doc_id, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) - 1 as pos from documents),
    old as (select doc_id, pos, concat(pos, '. ', line) as clause from split),
    revised as (
        select doc_id, case when pos % 9 = 8 then pos + 4.5 else pos end as place, case when pos % 5 = 4 then clause || ' (rev.)' else clause end as clause
        from old where pos % 7 <> 3
        union all select doc_id, pos + 0.25, 'new ' || clause from old where pos % 6 = 1),
    new as (select doc_id, row_number() over (partition by doc_id order by place) - 1 as pos, clause from revised),
    met as (select o.doc_id, o.pos as i, n.pos as j, row_number() over (partition by o.doc_id order by o.pos) as s
            from old o join new n on o.doc_id = n.doc_id and o.clause = n.clause),
    piles as (
        select doc_id, cast(0 as bigint) as s, cast([] as bigint[]) as tops, 0 as level from (select distinct doc_id from met)
        union all
        select p.doc_id, m.s, tops[1:len(list_filter(tops, lambda x: x < m.j))] || [m.j] || tops[len(list_filter(tops, lambda x: x < m.j)) + 2:],
               cast(len(list_filter(tops, lambda x: x < m.j)) + 1 as int)
        from piles p join met m on m.doc_id = p.doc_id and m.s = p.s + 1),
    levels as (select m.*, p.level from met m join piles p on p.doc_id = m.doc_id and p.s = m.s),
    behind as (select a.doc_id, a.s, max(b.s) as b from levels a join levels b on a.doc_id = b.doc_id and b.level = a.level - 1 and b.s < a.s group by all),
    run as (
        select doc_id, max(s) as s from levels l where level = (select max(level) from levels x where x.doc_id = l.doc_id) group by doc_id
        union all
        select r.doc_id, b.b from run r join behind b on b.doc_id = r.doc_id and b.s = r.s),
    kept as (select m.* from met m join run r on r.doc_id = m.doc_id and r.s = m.s),
    moved as (select * from met m where not exists (select 1 from run r where r.doc_id = m.doc_id and r.s = m.s)),
    gone as (
        select o.doc_id, o.pos, o.clause, (select count(*) from kept k where k.doc_id = o.doc_id and k.i < o.pos) as gap
        from old o where not exists (select 1 from met m where m.doc_id = o.doc_id and m.i = o.pos)),
    come as (
        select n.doc_id, n.pos, n.clause, (select count(*) from kept k where k.doc_id = n.doc_id and k.j < n.pos) as gap
        from new n where not exists (select 1 from met m where m.doc_id = n.doc_id and m.j = n.pos)),
    paired as (
        select coalesce(g.doc_id, c.doc_id) as doc_id, g.pos as old_pos, c.pos as new_pos, g.clause as old_clause, c.clause as new_clause
        from (select *, row_number() over (partition by doc_id, gap order by pos) as nth from gone) g full join
             (select *, row_number() over (partition by doc_id, gap order by pos) as nth from come) c
        on g.doc_id = c.doc_id and g.gap = c.gap and g.nth = c.nth)
    select doc_id, case when old_pos is null then 'added' when new_pos is null then 'removed' else 'edited' end as change,
           old_pos, new_pos, old_clause, new_clause from paired
    union all
    select m.doc_id, 'moved', i, j, clause, clause from moved m join old o on o.doc_id = m.doc_id and o.pos = m.i""")
def clause_level(t):
    numbered = F.concat(F.col("pos").cast("string"), F.lit(". "), F.col("clause"))
    old = clauses.split_clauses(t.documents, "doc_id", "text").withColumn("clause", numbered)
    revised = old.filter("pos % 7 <> 3").select(
        "doc_id", F.when(F.expr("pos % 9 = 8"), F.col("pos") + 4.5).otherwise(F.col("pos").cast("double")).alias("place"),
        F.when(F.expr("pos % 5 = 4"), F.concat("clause", F.lit(" (rev.)"))).otherwise(F.col("clause")).alias("clause"))
    added = old.filter("pos % 6 = 1").select("doc_id", (F.col("pos") + 0.25).alias("place"), F.concat(F.lit("new "), "clause").alias("clause"))
    nth = F.row_number().over(Window.partitionBy("doc_id").orderBy("place")) - 1
    return clauses.clause_changes(old, revised.unionByName(added).select("doc_id", nth.alias("pos"), "clause"), "doc_id")


@query("u2_distinct_codes", """
    select cpv_code from v_tender intersect select lpad(cast(c_custkey as varchar), 8, '0') from customer""", "v_tender")
def distinct_codes(t):
    known = t.customer.select(F.lpad(F.col("c_custkey").cast("string"), 8, "0").alias("cpv_code"))
    return domain.tenders(t).select("cpv_code").intersect(known)


@query("x16_publish_rules", """
    select coalesce(case when s <> 'draft' then concat('Cannot publish tender with status: ', s)
                when publication_date < date '1997-06-01' then 'Deadline must be in the future' end, 'ok') as outcome, count(*) as n
    from (select case status when 'open' then 'draft' else status end as s, publication_date from v_tender) group by 1""",
       "v_tender")
def publish_rules(t):
    status = F.when(F.col("status") == "open", "draft").otherwise(F.col("status"))
    error = workflows.publish_error(status, F.col("title"), F.col("publication_date"), F.to_date(F.lit("1997-06-01")))
    return domain.tenders(t).groupBy(F.coalesce(error, F.lit("ok")).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("x16_archive", """
    select kind, status, count(*) as n from (
        select 'tender' as kind, case when status = 'published' then status else 'archived' end as status from v_tender
        union all select 'lot', case when t.status = 'published' then 'active' else 'archived' end from v_lot l
        join v_tender t on t.code = l.tender_code) group by all""", "v_tender v_lot")
def archive(t):
    tenders = domain.tenders(t).select("code", "status")
    lots = domain.lots(t).select("tender_code", F.lit("active").alias("status"))
    new_tenders, new_lots = workflows.archive(tenders, lots, tenders)
    both = new_tenders.select(F.lit("tender").alias("kind"), "status").unionByName(
        new_lots.select(F.lit("lot").alias("kind"), "status"))
    return both.groupBy("kind", "status").agg(F.count(F.lit(1)).alias("n"))
