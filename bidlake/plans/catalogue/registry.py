"""Query registry and the domain views in SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from bidlake.sources.tables import Tables

VIEWS = {
    "v_tender": """
        select cast(o_orderkey as varchar) as code, concat('Order ', o_orderkey) as title,
               lpad(cast((o_orderkey % 97) * 1000000 + o_custkey as varchar), 8, '0') as cpv_code,
               o_totalprice as base_amount, c_name as buyer_name, cast(o_orderdate as date) as publication_date,
               case o_orderstatus when 'O' then 'open' when 'F' then 'closed' else 'published' end as status
        from orders join customer on c_custkey = o_custkey""",
    "v_lot": """
        select concat(l_orderkey, '-', l_linenumber, '-', l_partkey, '-', l_suppkey) as id,
               cast(l_orderkey as varchar) as tender_code, concat(l_orderkey, '-', l_linenumber) as lot_code,
               concat('Lot ', l_linenumber) as name, lpad(cast(l_partkey as varchar), 8, '0') as cpv_code,
               l_extendedprice as base_amount, cast(l_partkey as varchar) as requirement_id
        from lineitem""",
    "v_requirement": """
        select cast(p_partkey as varchar) as id, p_type as type, p_name as description, p_size >= 25 as mandatory
        from part""",
    "v_related": """
        select cast((p_partkey - 1) // 8 as varchar) as src, cast(p_partkey as varchar) as dst
        from part where p_partkey > 0""",
    "v_deadline": """
        select cast(l_orderkey as varchar) as tender_code, l_returnflag as type, cast(l_shipdate as date) as date,
               concat('line ', l_linenumber) as notes from lineitem""",
    "v_penalty": """
        select cast(l_orderkey as varchar) as tender_code, l_extendedprice * l_discount as amount
        from lineitem where l_returnflag = 'R'""",
    "v_section": """
        select vec_id as doc_id, case when label <= 2 then 'requirements' when label <= 4 then 'deadlines'
               when label <= 6 then 'evaluation' else 'other' end as section_type from embeddings""",
    "v_token": r"""
        select doc_id, lang, source,
               list_filter(regexp_split_to_array(text, '[ \t\n\x0b\f\r]+'), lambda x: x <> '') as toks
        from documents""",
    "v_window": """
        select doc_id, lang, source, toks, unnest(range(0, greatest(len(toks) - 30 - 1, 0) + 1, 170)) as s
        from v_token where len(toks) > 0""",
    "v_chunk": """
        select concat(w.doc_id, '-', s // 170) as id, cast(w.doc_id as varchar) as tender_code, w.doc_id,
               cast(s // 170 as int) as chunk_index, array_to_string(toks[s + 1:s + 200], ' ') as text,
               coalesce(section_type, 'other') as section_type, lang, source
        from v_window w left join v_section c on c.doc_id = w.doc_id""",
}
_NEEDS = {"v_chunk": ("v_section", "v_token", "v_window")}


@dataclass(frozen=True)
class Query:
    name: str
    build: Callable[[Tables], DataFrame]
    sql: str | None

    def __call__(self, spark: SparkSession, folder: str) -> DataFrame:
        return self.build(Tables(spark, folder))


REGISTRY: dict[str, Query] = {}


def query(name: str, sql: str | None = None, views: str = "") -> Callable:
    """Register a query; ``views`` names the domain views its SQL reads."""
    def add(build: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Query(name, build, _with_views(sql, views.split()) if sql else None)
        return build
    return add


def _with_views(sql: str, names: list[str]) -> str:
    ordered: list[str] = []
    for name in names:
        ordered += [n for n in (*_NEEDS.get(name, ()), name) if n not in ordered]
    sql = sql.strip()
    if not ordered:
        return sql
    ctes = ",\n".join(f"{n} as ({VIEWS[n].strip()})" for n in ordered)
    if sql.lower().startswith("with recursive "):
        return f"with recursive {ctes},\n{sql[len('with recursive '):]}"
    if sql.lower().startswith("with "):
        return f"with {ctes},\n{sql[5:]}"
    return f"with {ctes}\n{sql}"
