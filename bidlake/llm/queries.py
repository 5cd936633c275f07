"""The registered queries of the subpackage and, where SQL can say the same, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from bidlake.llm import alignment, hnsw, language, lines, mixing, packing, repair, sharding, signature_join, suffixes, token_store, toxicity, vector_dedup
from bidlake.llm.tokens import vocabulary_path


def _table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def _vectors(spark: SparkSession, folder: str) -> DataFrame:
    return _table(spark, folder, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


def op1_best_fit_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(_table(spark, folder, "documents"), vocabulary_path())


def op2_hnsw_neighbours(spark: SparkSession, folder: str) -> DataFrame:
    rows = _vectors(spark, folder)
    return hnsw.search(hnsw.build_index(rows, 11), rows.filter(F.col("id") % 100 == 0), 10)


def op3_pareto_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(_table(spark, folder, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op4_subword_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return toxicity.score(docs, toxicity.fit(docs, _table(spark, folder, "labels")))


def op5_extendible_shards(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.shard(_table(spark, folder, "documents")).select("doc_id", "n_bytes", "depth", "shard", "shard_bytes", "shard_docs")


def op6_subword_language(spark: SparkSession, folder: str) -> DataFrame:
    docs = _table(spark, folder, "documents")
    return language.predict(docs, language.fit(docs))


def op7_signature_join(spark: SparkSession, folder: str) -> DataFrame:
    return signature_join.near_duplicates(_table(spark, folder, "documents"))


def op8_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return suffixes.remove_repeats(_table(spark, folder, "documents"))


def op9_pca_tiles(spark: SparkSession, folder: str) -> DataFrame:
    return vector_dedup.near_duplicates(_vectors(spark, folder))


def op10_token_store(spark: SparkSession, folder: str) -> DataFrame:
    return token_store.stored_index(_table(spark, folder, "documents"), vocabulary_path())


def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repair.damage_and_repair(_table(spark, folder, "conversations"))


def op12_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = lines.dedup_lines(_table(spark, folder, "documents"))
    return found.select("row.doc_id", "n_lines", "n_dropped", F.sha2("kept", 256).alias("kept_sha256"))


def op13_token_alignment(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment_digest(_table(spark, folder, "documents"))


QUERIES = {f.__name__: f for f in (
    op1_best_fit_packing, op2_hnsw_neighbours, op3_pareto_mix, op4_subword_toxicity, op5_extendible_shards,
    op6_subword_language, op7_signature_join, op8_suffix_dedup, op9_pca_tiles, op10_token_store, op11_conversation_repair,
    op12_line_dedup, op13_token_alignment)}

SQL = {
    "op3_pareto_mix": r"""
        with sized as (
            select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) as size,
                   (cast(cast('0x' || substr(md5('mix-1|' || cast(doc_id as varchar)), 1, 13) as bigint) as double) + 0.5)
                       / 4503599627370496.0 as u
            from documents),
        totals as (select source, cast(sum(size) as bigint) as words from sized group by source),
        weighed as (
            select source, words,
                   cast([5, 2, 1][cast((row_number() over (order by source nulls last) - 1) % 3 + 1 as int)] as double) as weight
            from totals),
        level_of as (
            select a.source, a.words, a.weight, 3 * a.words / a.weight as full_at,
                   ((select sum(words) from weighed) - 3 * coalesce(sum(b.words), 0))
                       / ((select sum(weight) from weighed) - coalesce(sum(b.weight), 0)) as level
            from weighed a left join weighed b
              on (3 * b.words / b.weight, b.source) < (3 * a.words / a.weight, a.source)
            group by all),
        shared as (select level as share, full_at as water from level_of where level <= full_at order by full_at, source limit 1),
        targets as (
            select source, words, case when full_at < water then 3.0::double * words
                else least(share * weight, 3.0::double * words) end as target
            from level_of, shared),
        drawn as (
            select doc_id, size, words as source_size, target, s.source, u,
                   case when words > 0 then least(target / words, 3.0::double) else 0.0::double end as rate
            from sized s join targets t on s.source is not distinct from t.source),
        ranked as (
            select *, floor(rate) as whole,
                   case when rate - floor(rate) > 0 then u * (1 - (rate - floor(rate)))
                       / (u * (1 - (rate - floor(rate))) + (1 - u) * (rate - floor(rate))) end as rank
            from drawn),
        summed as (
            select *, target - sum(whole * size) over (partition by source) as lack,
                   sum(case when rank is not null then size end) over (partition by source order by rank nulls last, doc_id, size
                       rows between unbounded preceding and current row) - size as before
            from ranked)
        select doc_id, cast(size as bigint) as size, cast(source_size as bigint) as source_size, target,
               cast((whole + case when rank is not null and 2 * before + size <= 2 * lack then 1 else 0 end) * size as bigint) as taken
        from summed""",
    "op5_extendible_shards": r"""
        with hashed as (
            select doc_id, coalesce(strlen(text), 0) as n_bytes,
                   cast('0x' || substr(md5(cast(doc_id as varchar)), 1, 12) as bigint) as hash
            from documents),
        levels as (select h.*, d as depth, hash >> (48 - d) as prefix from hashed h, (select unnest(range(0, 49)) as d)),
        sums as (select depth, prefix, sum(n_bytes) as shard_bytes, count(*) as shard_docs from levels group by all),
        fits as (
            select l.doc_id, l.hash, l.n_bytes, min_by(struct_pack(d := l.depth, b := shard_bytes, c := shard_docs), l.depth) as s
            from levels l join sums s on l.depth = s.depth and l.prefix = s.prefix
            where shard_bytes <= 1048576 or l.depth = 48 group by all)
        select doc_id, cast(n_bytes as bigint) as n_bytes, cast(s.d as int) as depth,
               substr(lpad(bin(hash), 48, '0'), 1, s.d) as shard, cast(s.b as bigint) as shard_bytes, s.c as shard_docs
        from fits""",
    "op11_conversation_repair": r"""
        with recursive named as (
            select *, row_number() over () as nr, coalesce(cast(conv_id as varchar), ' ') || ':' || coalesce(cast(turn as varchar), ' ') as name from conversations),
        -- crc32, bit by bit: a byte enters, then eight shifts (-1) follow
        dealt as (
            select *, xor(list_reduce(
                list_prepend(4294967295::bigint, flatten(list_transform(
                    string_split(name, ''), lambda c: list_concat([ascii(c)::bigint], list_transform(range(8), lambda i: -1::bigint))))),
                lambda crc, x: case when x >= 0 then xor(crc, x) when crc % 2 = 1 then xor(crc >> 1, 3988292384::bigint) else crc >> 1 end),
                4294967295::bigint) % 20 as fault
            from named),
        damaged as (
            select conv_id, turn, nr, case when fault = 4 then 'user' else coalesce(role, ' ') end as role,
                   case fault when 1 then '' when 2 then regexp_replace(coalesce(text, ' '), '[.!?]', '', 'g') else coalesce(text, ' ') end as text,
                   unnest(case fault when 0 then [] when 3 then [1, 2] else [1] end) as copy
            from dealt),
        placed as (
            select *, row_number() over (partition by conv_id order by turn nulls first, role, text, nr, copy) as place,
                   row_number() over (partition by conv_id, role, text order by turn nulls first, nr, copy) > 1 as again,
                   left(role, 1) as initial, left(lag(role) over (partition by conv_id order by turn nulls first, role, text, nr, copy), 1) as before,
                   rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) as body
            from damaged),
        judged as (
            select *, case when body = '' then 'blank' when again then 'duplicate' when right(body, 1) not in ('.', '!', '?') then 'truncated' end as fault
            from placed),
        inserts(state, n, reached, added) as (
            values ('', 0, '', []), ('', 1, 'u', ['user:']), ('', 2, 'a', ['user:', 'assistant:']),
                   ('s', 0, 's', []), ('s', 1, 'u', ['user:']), ('s', 2, 'a', ['user:', 'assistant:']),
                   ('u', 0, 'u', []), ('u', 1, 'a', ['assistant:']), ('a', 0, 'a', []), ('a', 1, 'u', ['user:'])),
        edits(edit, price) as (values ('K', 0), ('R', 1), ('D', 2)),
        walk as (
            select conv_id, cast(0 as bigint) as place, '' as state, cast(0 as bigint) as cost, '' as audit, cast([] as varchar[]) as said
            from (select distinct conv_id from damaged)
            union all
            select conv_id, place, state, best.cost, best.audit, best.said from (
                select w.conv_id, j.place,
                       case when e.edit = 'D' then i.reached when e.edit = 'K' then j.initial when i.reached = 'u' then 'a' else 'u' end as state,
                       min(struct_pack(
                           cost := cast(w.cost + 5 * i.n + e.price + case when j.fault = 'truncated' and e.edit <> 'D' then 5 else 0 end as bigint),
                           audit := w.audit || repeat('I', i.n) || e.edit,
                           said := w.said || i.added || case when e.edit = 'D' then [] when e.edit = 'K' then [j.role || ':' || j.text]
                                                             when i.reached = 'u' then ['assistant:' || j.text] else ['user:' || j.text] end)) as best
                from walk w join judged j on j.conv_id is not distinct from w.conv_id and j.place = w.place + 1
                join inserts i on i.state = w.state
                join edits e on e.edit = 'D' or coalesce(j.fault, '') not in ('blank', 'duplicate') and (
                    e.edit = 'R' or j.initial = 's' and i.reached = '' or j.initial = 'u' and i.reached <> 'u'
                    or j.initial = 'a' and i.reached = 'u')
                group by all)),
        counted as (
            select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
                   count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
                   count(*) filter (fault = 'truncated') as truncated,
                   count(*) filter (before is not null and before || initial not in ('su', 'ua', 'au')) as illegal
            from judged group by conv_id),
        ended as (
            select w.conv_id, min(struct_pack(cost := w.cost + 5 * i.n, audit := w.audit || repeat('I', i.n), said := w.said || i.added)) as best
            from walk w join counted c on c.conv_id is not distinct from w.conv_id and c.n = w.place
            join inserts i on i.state = w.state and i.reached in ('', 'a')
            group by w.conv_id)
        select o.conv_id, cast(coalesce(gaps, 0) as bigint) as gaps, coalesce(blank, 0) as blank, coalesce(duplicate, 0) as duplicate,
               coalesce(truncated, 0) as truncated, coalesce(illegal, 0) as illegal, cast(coalesce(best.cost, 0) as bigint) as cost,
               coalesce(best.audit, '') as audit, sha256(coalesce(array_to_string(best.said, chr(10)), '')) as repaired_sha256
        from (select distinct conv_id from conversations) o left join counted c on c.conv_id is not distinct from o.conv_id
        left join ended e on e.conv_id is not distinct from o.conv_id""",
    "op12_line_dedup": r"""
        with docs as (select row_number() over () as row, doc_id, string_split(coalesce(text, ''), chr(10)) as split from documents),
        lines as (select row, doc_id, unnest(split) as line, generate_subscripts(split, 1) as pos from docs),
        keyed as (
            select *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as key
            from lines),
        common as (
            select key, max(doc_id) as hi from keyed where length(key) >= 20 group by key
            having count(distinct doc_id) + max(cast(doc_id is null as int)) >= 3),
        judged as (
            select k.*, c.key is not null and (k.doc_id < hi or k.doc_id is null and hi is not null) as dropped
            from keyed k left join common c on k.key = c.key)
        select doc_id, count(*) as n_lines, count(*) filter (dropped) as n_dropped,
               sha256(coalesce(string_agg(line, chr(10) order by pos) filter (not dropped), '')) as kept_sha256
        from judged group by row, doc_id""",
}
