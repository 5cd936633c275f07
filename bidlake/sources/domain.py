"""Tender-domain vertex and edge views over the given tables.

Edges with one parent per child are kept as a foreign-key column on the child, so that walking
an edge is one equi join. Every view is a narrow projection (``tenders`` adds one join to its
buyer), which leaves pruning and pushdown to the readers of the view.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.operators.chunking import token_chunks
from bidlake.sources.tables import Tables

CHUNK_SIZE = 200
CHUNK_OVERLAP = 30


def _keyed(df: DataFrame, key: str, codes: Sequence[str] | None) -> DataFrame:
    """Rows of some tenders, by the stored number, so that the filter reaches the scan. Codes that are no number
    name no tender."""
    if codes is None:
        return df
    numbers = [int(c) for c in codes if c.isascii() and c.isdigit() and c == str(int(c))]
    return df.filter(F.col(key).isin(numbers)) if numbers else df.filter(F.lit(False))


def tenders(t: Tables, codes: Sequence[str] | None = None, published: tuple[str, str] | None = None,
            only: DataFrame | None = None) -> DataFrame:
    """All tenders, those with the given codes, those published between two days (both included), or those of the
    documents whose ``doc_id`` is in ``only``, which are picked before they meet their buyers."""
    orders = _keyed(t.orders, "o_orderkey", codes)
    if only is not None:
        orders = orders.join(only.select("doc_id"), F.col("o_orderkey") == F.col("doc_id"), "left_semi")
    if published is not None:
        # in the stored type, with or without a zone, so that the column itself is compared
        kind = t.orders.schema["o_orderdate"].dataType
        first, last = (F.to_date(F.lit(day)) for day in published)
        orders = orders.filter((F.col("o_orderdate") >= first.cast(kind)) & (F.col("o_orderdate") < F.date_add(last, 1).cast(kind)))
    return orders.join(t.customer, F.col("o_custkey") == F.col("c_custkey")).select(
        F.col("o_orderkey").cast("string").alias("code"),
        F.concat(F.lit("Order "), F.col("o_orderkey").cast("string")).alias("title"),
        F.lpad((F.col("o_orderkey") % 97 * 1000000 + F.col("o_custkey")).cast("string"), 8, "0").alias("cpv_code"),
        F.col("o_totalprice").alias("base_amount"),
        F.col("c_name").alias("buyer_name"),
        F.col("o_orderdate").cast("date").alias("publication_date"),
        F.when(F.col("o_orderstatus") == "O", "open")
        .when(F.col("o_orderstatus") == "F", "closed")
        .otherwise("published").alias("status"),
    )


def lots(t: Tables, codes: Sequence[str] | None = None) -> DataFrame:
    """Lots, of some tenders if ``codes`` are given, with their parent (HAS_LOT) and the requirement each one names (REQUIRES)."""
    line = F.concat(F.col("l_orderkey").cast("string"), F.lit("-"), F.col("l_linenumber").cast("string"))
    part = F.col("l_partkey").cast("string")
    return _keyed(t.lineitem, "l_orderkey", codes).select(
        F.concat(line, F.lit("-"), part, F.lit("-"), F.col("l_suppkey").cast("string")).alias("id"),
        F.col("l_orderkey").cast("string").alias("tender_code"),
        line.alias("lot_code"),
        F.concat(F.lit("Lot "), F.col("l_linenumber").cast("string")).alias("name"),
        F.lpad(part, 8, "0").alias("cpv_code"),
        F.col("l_extendedprice").alias("base_amount"),
        part.alias("requirement_id"),
    )


def requirements(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").cast("string").alias("id"),
        F.col("p_type").alias("type"),
        F.col("p_name").alias("description"),
        (F.col("p_size") >= 25).alias("mandatory"),
    )


def related_requirements(t: Tables) -> DataFrame:
    """RELATED_TO: each requirement depends on the ones numbered 8k+1 to 8k+8."""
    return t.part.filter("p_partkey > 0").select(
        F.expr("(p_partkey - 1) div 8").cast("string").alias("src"), F.col("p_partkey").cast("string").alias("dst")
    )


def deadlines(t: Tables, codes: Sequence[str] | None = None) -> DataFrame:
    return _keyed(t.lineitem, "l_orderkey", codes).select(
        F.col("l_orderkey").cast("string").alias("tender_code"),
        F.col("l_returnflag").alias("type"),
        F.col("l_shipdate").cast("date").alias("date"),
        F.concat(F.lit("line "), F.col("l_linenumber").cast("string")).alias("notes"),
    )


def penalties(t: Tables) -> DataFrame:
    return t.lineitem.filter("l_returnflag = 'R'").select(
        F.col("l_orderkey").cast("string").alias("tender_code"),
        (F.col("l_extendedprice") * F.col("l_discount")).alias("amount"),
    )


def organizations(t: Tables) -> DataFrame:
    """Buyers with their place (Organization vertices; ISSUED_BY is the tender's buyer name)."""
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("cf"), F.col("c_name").alias("name"),
        F.col("c_mktsegment").alias("type"), "c_nationkey",
    )


def cpv_classes(t: Tables) -> DataFrame:
    """CLASSIFIED_AS edges: tender code to two-digit CPV division."""
    return tenders(t).select("code", F.substring("cpv_code", 1, 2).alias("cpv_division"))


def sections(t: Tables) -> DataFrame:
    label = F.col("label")
    return t.embeddings.select(
        F.col("vec_id").alias("doc_id"),
        F.when(label <= 2, "requirements").when(label <= 4, "deadlines").when(label <= 6, "evaluation")
        .otherwise("other").alias("section_type"),
    )


def documents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", "text", "lang", "source")


def pages(t: Tables) -> DataFrame:
    return t.pages.select("page_id", "html")


def _chosen(t: Tables, only: DataFrame | None) -> DataFrame:
    return documents(t) if only is None else documents(t).join(only.select("doc_id"), "doc_id", "left_semi")


def _sectioned(t: Tables, rows: DataFrame) -> DataFrame:
    return rows.join(sections(t), "doc_id", "left").withColumn("section_type", F.coalesce("section_type", F.lit("other")))


def chunks(t: Tables, only: DataFrame | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """Token chunks of every document (Chunk vertices, HAS_CHUNK by ``tender_code``), or of the
    documents whose ``doc_id`` is in ``only``."""
    return token_chunks(_sectioned(t, _chosen(t, only)), "doc_id", "text", size, overlap).select(
        "id", F.col("doc_id").cast("string").alias("tender_code"), "doc_id", "chunk_index", "text",
        "section_type", "lang", "source",
    )


def chunk_links(t: Tables, only: DataFrame | None = None, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> DataFrame:
    """HAS_CHUNK edges and section of every chunk without building the chunk texts, or of the
    documents whose ``doc_id`` is in ``only``. The chunks meet their sections, so that no text is shuffled for them."""
    found = token_chunks(_chosen(t, only).select("doc_id", "text"), "doc_id", "text", size, overlap, with_text=False)
    return _sectioned(t, found.select("id", "doc_id", "chunk_index")).select(
        "id", F.col("doc_id").cast("string").alias("tender_code"), "doc_id", "chunk_index", "section_type"
    )


def vectors(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), "embedding", "label")


def questions(t: Tables) -> DataFrame:
    return t.benchmark.select(F.col("item_id").alias("qid"), F.col("text").alias("question"))
