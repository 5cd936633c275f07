"""Blocks, sections, chunks, entities and other text queries."""

from pyspark.sql import functions as F

from bidlake.functions import text as X
from bidlake.functions.language import detect_language, language_profiles
from bidlake.functions.vectors import length_embedding
from bidlake.operators.chunking import document_chunks, html_blocks, merge_similar_paragraphs, section_chunks, token_chunks
from bidlake.plans import ingest, retrieval
from bidlake.plans.catalogue.registry import query
from bidlake.sources import domain

_PIECES = r"""
    shown as (select page_id, string_split(regexp_replace(
            regexp_replace(html, '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'),
            '(?is)<h[1-6][^>]*>.*?</h[1-6]>|<p(?: [^>]*)?>.*?</p>|<li[^>]*>.*?</li>|<table[^>]*>.*?</table>',
            chr(1) || '\0' || chr(1), 'g'), chr(1)) as parts from pages),
    part_of as (select page_id, unnest(parts) as part, unnest(range(len(parts))) as k from shown),
    bits as (select page_id, k, case when k % 2 = 1 then [part] else regexp_split_to_array(part,
            '(?is)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|figcaption|figure|footer|form|head|header|hr|html|main|nav|ol|p|pre|section|title|ul)(?:[ \t\r\n][^>]*)?/?>') end as ps
        from part_of),
    piece as (select page_id, unnest(ps) as piece, k % 2 = 1 as whole, k * 1000000 + unnest(range(len(ps))) as n from bits),
    plain as (select page_id, n, case when whole then lower(substring(piece, 2, 2)) else '' end as tag,
        trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(piece, '(?s)<[^>]*>', ' ', 'g'),
            '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g')) as text
        from piece),
    block as (select page_id, tag, text, row_number() over (partition by page_id order by n) - 1 as pos,
        case when tag similar to 'h[1-6]' then 'heading' when tag = 'li' then 'list_item' when tag = 'ta' then 'table'
             else 'paragraph' end as type from plain where text <> '')"""
_SECTIONS = f"""{_PIECES},
    cut as (select *, sum(case when type = 'heading' or pos = 0 then 1 else 0 end) over (partition by page_id order by pos) - 1 as k
            from block),
    section as (select page_id, cast(k as int) as section_index, max(case when type = 'heading' then text end) as title,
        coalesce(string_agg(case when type <> 'heading' then text end, chr(10) order by pos), '') as text,
        cast(count(*) as int) as n_blocks from cut group by page_id, k)"""


@query("d13_html_blocks", f"with {_PIECES} select page_id, cast(pos as int) as pos, type, text from block")
def blocks(t):
    found = html_blocks(domain.pages(t), "html")
    return found.select("page_id", F.posexplode("blocks").alias("pos", "b")).select("page_id", "pos", "b.type", "b.text")


@query("d1_sections", f"""with {_SECTIONS}
    select concat(page_id, '#', section_index) as id, page_id, section_index, title, text, n_blocks,
           case when title is null then '' else title end as section_path from section""")
def sections(t):
    found = section_chunks(html_blocks(domain.pages(t), "html"), "page_id")
    return found.select("id", "page_id", "section_index", "title", "text", F.size("blocks").alias("n_blocks"), "section_path")


@query("d3_section_tokens", f"""with {_SECTIONS},
    tok as (select concat(page_id, '#', section_index) as source_chunk_id, coalesce(title, '') as section_path,
        list_filter(regexp_split_to_array(concat_ws(chr(10), title, nullif(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as toks
        from section),
    win as (select *, unnest(range(0, greatest(len(toks) - 20 - 1, 0) + 1, 80)) as s from tok where len(toks) > 0)
    select concat(source_chunk_id, '-', s // 80) as id, source_chunk_id, section_path, array_to_string(toks[s + 1:s + 100], ' ') as text
    from win""")
def section_tokens(t):
    found = document_chunks(html_blocks(domain.pages(t), "html"), "page_id", 100, 20)
    return found.select("id", "source_chunk_id", "section_path", "text")


@query("d2_chunks", "select id, doc_id, chunk_index, text from v_chunk", "v_chunk")
def chunks(t):
    return domain.chunks(t).select("id", "doc_id", "chunk_index", "text")


@query("d2_chunks_default", r"""
    with tok as (select doc_id, list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as toks from documents),
    win as (select doc_id, toks, unnest(range(0, greatest(len(toks) - 120 - 1, 0) + 1, 680)) as s from tok where len(toks) > 0)
    select concat(doc_id, '-', s // 680) as id, cast(least(800, len(toks) - s) as int) as n_tokens,
           md5(array_to_string(toks[s + 1:s + 800], ' ')) as digest from win""")
def chunks_default(t):
    found = token_chunks(domain.documents(t), "doc_id", "text")
    return found.select("id", "n_tokens", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("d2_min_tokens", f"""with {_SECTIONS},
    tok as (select concat(page_id, '#', section_index) as source,
        list_filter(regexp_split_to_array(concat_ws(chr(10), title, nullif(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as toks
        from section),
    win as (select source, toks, len(toks) as n, unnest(range(0, greatest(len(toks) - 5 - 1, 0) + 1, 35)) as s from tok where len(toks) > 0),
    fit as (select *, max(s) over (partition by source) as last from win where s = 0 or n - s >= 20),
    made as (select concat(source, '-', s // 35) as id, toks[s + 1:case when s = last then n else s + 40 end] as ts from fit)
    select id, cast(len(ts) as int) as n_tokens, md5(array_to_string(ts, ' ')) as digest from made""")
def min_tokens(t):
    found = document_chunks(html_blocks(domain.pages(t), "html"), "page_id", 40, 5, 20)
    return found.select("id", "n_tokens", F.md5(F.encode("text", "UTF-8")).alias("digest"))


@query("d4_preview", "select doc_id, coalesce(substring(text, 1, 200), '') as text_preview from documents")
def preview(t):
    return t.documents.select("doc_id", X.preview("text").alias("text_preview"))


@query("d6_section_class", """
    select case when contains(lower(p_name), 'requisiti') then 'requirements'
                when contains(lower(p_name), 'scadenza') then 'deadlines' else 'other' end as section_type, count(*) as n
    from (select case p_partkey % 3 when 0 then concat(p_name, ' REQUISITI') when 1 then concat(p_name, ' Scadenza') else p_name end
          as p_name from part) group by 1""")
def section_class(t):
    n = F.col("p_partkey") % 3
    title = F.concat("p_name", F.when(n == 0, " REQUISITI").when(n == 1, " Scadenza").otherwise(""))
    return t.part.groupBy(X.section_type(title).alias("section_type")).agg(F.count(F.lit(1)).alias("n"))


_PATTERNS = {"amounts": r"[0-9]+(?:[.,][0-9]+)*", "organisations": r"[A-Z][a-z]+ [A-Z][a-z]+", "requirements": r"(?:[Dd]ass|[Ii]s) "}


@query("d7_entities", r"""
    select doc_id, 'amounts' as kind, unnest(regexp_extract_all(text, '[0-9]+(?:[.,][0-9]+)*')) as entity from documents
    union all select doc_id, 'organisations', unnest(regexp_extract_all(text, '[A-Z][a-z]+ [A-Z][a-z]+')) from documents
    union all select doc_id, 'requirements', unnest(regexp_extract_all(text, '(?:[Dd]ass|[Ii]s) ')) from documents""")
def entities(t):
    found = domain.documents(t).select("doc_id", X.entities("text", _PATTERNS).alias("e"))

    def labelled(kind):
        return F.transform(F.col(f"e.{kind}"), lambda x: F.struct(F.lit(kind).alias("kind"), x.alias("entity")))

    kinds = F.flatten(F.array(*[labelled(kind) for kind in _PATTERNS]))
    return found.select("doc_id", F.explode(kinds).alias("x")).select("doc_id", "x.kind", "x.entity")


@query("d8_entity_flags", r"""
    select regexp_matches(text, '[0-9]+(?:[.,][0-9]+)*') as has_amounts,
           regexp_matches(text, '[A-Z][a-z]+ [A-Z][a-z]+') as has_organisations, count(*) as n from documents group by all""")
def entity_flags(t):
    flags = t.documents.select(F.inline(F.array(X.entity_flags("text", _PATTERNS))))
    return flags.groupBy("has_amounts", "has_organisations").agg(F.count(F.lit(1)).alias("n"))


@query("d9_language", "select lang, count(*) as n from documents group by 1")
def language(t):
    return t.documents.groupBy("lang").agg(F.count(F.lit(1)).alias("n"))


@query("d9_detected", r"""
    with s as (select doc_id, lang, ' ' || trim(regexp_replace(lower(text), '[^\p{L}]+', ' ', 'g')) || ' ' as s from documents),
    c as (select doc_id, lang, string_split(s, '') as c from s where trim(s) <> ''),
    g as (select doc_id, lang, c[i] || c[i + 1] || c[i + 2] as gram from (select *, unnest(range(1, len(c) - 1)) as i from c)),
    p as (select lang, gram, row_number() over (partition by lang order by count(*) desc, gram) as rank from g where lang is not null
          group by lang, gram qualify rank <= 300),
    d as (select doc_id, gram, row_number() over (partition by doc_id order by count(*) desc, gram) as rank from g
          group by doc_id, gram qualify rank <= 300),
    o as (select doc_id, lang, sum(abs(d.rank - p.rank) - 300) as off from d join p using (gram) group by doc_id, lang),
    n as (select doc_id, lang from o qualify row_number() over (partition by doc_id order by off, lang) = 1)
    select doc_id, n.lang as detected from documents left join n using (doc_id)""")
def detected(t):
    profiles = language_profiles(t.documents, "lang", "text")
    return detect_language(t.documents, profiles, "doc_id", "text")


@query("d10_similar_paragraphs", r"""
    with recursive ps as (select doc_id, list_filter(string_split(text, chr(10)), lambda p: trim(p, ' ') <> '') as parts from documents),
    par as (select doc_id, unnest(parts) as body, unnest(range(len(parts))) as n from ps),
    sized as (select doc_id, n, body, len(list_filter(regexp_split_to_array(body, '[ \t\n\x0b\f\r]+'), lambda x: x <> '')) as toks,
        list_transform(range(4), lambda i: length(body) / 1000.0e0 + i / 4.0e0) as v from par),
    near as (select a.doc_id, a.n, a.body, a.toks, coalesce(list_cosine_similarity(a.v, b.v) >= 0.999, false) as alike
        from sized a left join sized b on b.doc_id = a.doc_id and b.n = a.n - 1),
    chain(doc_id, n, chunk_index, total) as (
        select doc_id, n, 0, toks from near where n = 0
        union all
        select x.doc_id, x.n, case when x.alike and c.total + x.toks <= 200 then c.chunk_index else c.chunk_index + 1 end,
               case when x.alike and c.total + x.toks <= 200 then c.total + x.toks else x.toks end
        from chain c join near x on x.doc_id = c.doc_id and x.n = c.n + 1)
    select concat(doc_id, '-', chunk_index) as id, doc_id, cast(chunk_index as int) as chunk_index, cast(sum(toks) as int) as n_tokens,
           md5(string_agg(body, chr(10) order by n)) as digest
    from chain join near using (doc_id, n) group by doc_id, chunk_index""")
def similar_paragraphs(t):
    paragraphs = F.filter(F.split("text", "\n"), lambda p: F.trim(p) != "")
    with_parts = domain.documents(t).select("doc_id", paragraphs.alias("paragraphs"))
    vectors = F.transform("paragraphs", lambda p: length_embedding(p, 4))
    merged = merge_similar_paragraphs(with_parts.select("doc_id", "paragraphs", vectors.alias("vectors")),
                                      "doc_id", "paragraphs", "vectors", 0.999, 200)
    return merged.withColumn("digest", F.md5(F.encode("text", "UTF-8"))).drop("text")


@query("d11_clean", r"""
    select doc_id, md5(trim(regexp_replace(regexp_replace(regexp_replace(text, '\r\n?', chr(10), 'g'),
        '[\x00-\x08\x0b\x0c\x0e-\x1f\x7f\x{FFFD}\x{200B}\x{FEFF}]', '', 'g'), '[ \t\x{00A0}]+', ' ', 'g'))) as digest from documents""")
def clean(t):
    return domain.documents(t).select("doc_id", F.md5(F.encode(X.clean("text"), "UTF-8")).alias("digest"))


@query("d12_length_embedding", """
    select doc_id, cast(i as int) as position, round(length(text) / 1000.0e0 + i / 8.0e0, 6) as x from documents, range(8) r(i)""")
def embedding(t):
    vectors = t.documents.select("doc_id", length_embedding("text", 8).alias("v"))
    return vectors.select("doc_id", F.posexplode("v").alias("position", "x")).withColumn("x", F.round("x", 6))


@query("f21_citation_fields", f"""with {_SECTIONS},
    tok as (select concat(page_id, '#', section_index) as source_chunk_id, coalesce(title, '') as section_path,
        list_filter(regexp_split_to_array(concat_ws(chr(10), title, nullif(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as toks
        from section),
    win as (select *, unnest(range(0, greatest(len(toks) - 120 - 1, 0) + 1, 680)) as s from tok where len(toks) > 0)
    select concat(source_chunk_id, '-', s // 680) as id, section_path, source_chunk_id, 1 as page,
           cast(s // 680 as varchar) as chunk_index from win""")
def citation_fields(t):
    found = retrieval.citations(ingest.ingest_blocks(html_blocks(domain.pages(t), "html"), "page_id", 4, min_tokens=0))
    return found.select("id", "section_path", "source_chunk_id", F.get("page_numbers", F.lit(0)).alias("page"),
                        F.col("metadata")["chunk_index"].alias("chunk_index"))


@query("c5_ingest_blocks", f"""with {_SECTIONS},
    tok as (select concat(page_id, '#', section_index) as source_chunk_id, cast(page_id as varchar) as tender_id, coalesce(title, '') as section_path,
        list_filter(regexp_split_to_array(concat_ws(chr(10), title, nullif(text, '')), '[ \\t\\n\\x0b\\f\\r]+'), lambda x: x <> '') as toks
        from section),
    win as (select *, unnest(range(0, greatest(len(toks) - 120 - 1, 0) + 1, 680)) as s from tok where len(toks) > 0)
    select concat(source_chunk_id, '-', s // 680) as id, source_chunk_id, section_path, tender_id, 16 as dim,
           round(length(array_to_string(toks[s + 1:s + 800], ' ')) / 1000.0e0 + 3 / 16.0e0, 5) as fourth from win""")
def ingest_blocks(t):
    rows = ingest.ingest_blocks(html_blocks(domain.pages(t), "html"), "page_id", 16, min_tokens=0)
    return rows.select("id", "source_chunk_id", "section_path", "tender_id", F.size("embedding").alias("dim"),
                       F.round(F.get("embedding", F.lit(3)).cast("double"), 5).alias("fourth"))
