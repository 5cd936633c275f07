"""Property-graph patterns over vertex and edge DataFrames.

One-parent edges (HAS_LOT, HAS_CHUNK) are the ``tender_code`` column of the child. Children are
counted or summed by key before they meet their parents, so a parent holding a large share of all
children costs one row per task in the join. Member lists come back as rows, not as one array.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.text import icontains, preview
from bidlake.functions.validation import duplicate_keys
from bidlake.session import cut_lineage

TENDER_COLUMNS = ("code", "title", "cpv_code", "base_amount", "buyer_name", "publication_date")


def latest_first(date: str = "publication_date", tie: str = "code") -> list[Column]:
    """Newest first with unknown dates leading, and a unique tie-break."""
    return [F.desc_nulls_first(date), F.asc(tie)]


def tender_by_code(tenders: DataFrame, code: str) -> DataFrame:
    return tenders.filter(F.col("code") == code).select(*TENDER_COLUMNS)


def tenders_by_cpv(tenders: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    return (tenders.filter(F.col("cpv_code").startswith(prefix)).select(*TENDER_COLUMNS)
            .orderBy(*latest_first()).limit(limit))


def tenders_by_buyer(tenders: DataFrame, buyer: str, limit: int = 10) -> DataFrame:
    return (tenders.filter(icontains("buyer_name", buyer))
            .select("code", "title", "buyer_name", "base_amount", "publication_date")
            .orderBy(*latest_first()).limit(limit))


def lot_totals(lots: DataFrame) -> DataFrame:
    return lots.groupBy("tender_code").agg(
        F.count(F.lit(1)).alias("lot_count"), F.sum("base_amount").alias("total_lots_amount"))


def tenders_with_lots(tenders: DataFrame, lots: DataFrame, code: str | None = None) -> DataFrame:
    """Tender rows with the number of lots and their total; 0 and 0 for a tender without lots."""
    if code is not None:
        tenders = tenders.filter(F.col("code") == code)
        lots = lots.filter(F.col("tender_code") == code)
    joined = tenders.join(lot_totals(lots), F.col("code") == F.col("tender_code"), "left")
    return joined.select(
        "code", "title", "base_amount",
        F.coalesce("lot_count", F.lit(0)).alias("lot_count"),
        F.coalesce("total_lots_amount", F.lit(0).cast(lots.schema["base_amount"].dataType)).alias("total_lots_amount"))


def tender_lot_rows(tenders: DataFrame, lots: DataFrame, code: str | None = None) -> DataFrame:
    """Tender and lot side by side, one row per lot; a tender without lots has one row of nulls."""
    if code is not None:
        tenders = tenders.filter(F.col("code") == code)
        lots = lots.filter(F.col("tender_code") == code)
    members = lots.select(
        "tender_code", F.col("id").alias("lot_id"), F.col("name").alias("lot_name"),
        F.col("cpv_code").alias("lot_cpv_code"), F.col("base_amount").alias("lot_amount"))
    parents = tenders.select("code", "title", "base_amount")
    # the side that may be skewed leads an inner join, where AQE can split it; a left outer join
    # from the parents could not
    matched = members.join(parents, F.col("code") == F.col("tender_code")).drop("tender_code")
    return matched.unionByName(without_lots(parents, lots), allowMissingColumns=True).select(
        "code", "title", "base_amount", "lot_id", "lot_name", "lot_cpv_code", "lot_amount")


def without_lots(tenders: DataFrame, lots: DataFrame) -> DataFrame:
    parents = lots.select(F.col("tender_code").alias("code")).distinct()
    return tenders.join(parents, "code", "left_anti")


def chunk_context(chunk_ids: DataFrame | None, chunks: DataFrame, tenders: DataFrame, id_column: str = "id",
                  extra: Sequence[str] = ()) -> DataFrame:
    """Tender context of the given chunk ids, or of every chunk for ``None``; unknown ids vanish and repeated ids
    count once.

    ``extra`` names further columns of ``chunks`` to carry along.
    """
    links = chunks.select(F.col("id").alias("chunk_id"), "tender_code", *extra)
    if chunk_ids is not None:
        links = chunk_ids.select(F.col(id_column).alias("chunk_id")).distinct().join(links, "chunk_id")
    return (
        links.join(tenders, F.col("tender_code") == F.col("code"))
        .select("chunk_id", "tender_code", F.col("title").alias("tender_title"), "buyer_name", "cpv_code",
                "base_amount", "publication_date", *extra))


def related_tenders(tenders: DataFrame, code: str, limit: int = 5, one: DataFrame | None = None) -> DataFrame:
    """Tenders similar to one: 2 for the same CPV division, else 1 for the same buyer.

    The reference row enters as one scalar subquery, and the rest is a scan with a take-ordered. ``one``
    is that row where it can be had without reading all tenders.
    """
    one = tenders.filter(F.col("code") == code) if one is None else one
    wanted = one.select(F.struct(F.substring("cpv_code", 1, 2).alias("division"), "buyer_name")).scalar()
    division, buyer = wanted["division"], wanted["buyer_name"]
    score = (F.when(F.col("cpv_code").startswith(division), 2).when(F.col("buyer_name") == buyer, 1).otherwise(0))
    return (
        tenders.filter(F.col("code") != code).withColumn("similarity_score", score)
        .filter("similarity_score > 0")
        .orderBy(F.desc("similarity_score"), *latest_first()).limit(limit)
        .select("code", "title", "buyer_name", "cpv_code", "base_amount", "similarity_score"))


def related_tenders_many(tenders: DataFrame, sources: DataFrame | None = None, limit: int = 5) -> DataFrame:
    """``related_tenders`` for every source tender (default: all), as (source_code, rank, …).

    No pair of tenders is ever emitted beyond the answer. All members of a CPV division share one
    ranking, so its first limit + 1 rows serve each of them; the buyer ranking is needed only
    where the division has at most ``limit`` rows, so its first 2 · limit + 1 rows are enough
    after leaving out the division. Both lists are cut map-side, then every source picks its own
    answer from the two short lists in its row.
    """
    sources = tenders if sources is None else sources
    division = F.substring("cpv_code", 1, 2)
    asked = sources.select(
        F.col("code").alias("source_code"), F.col("buyer_name").alias("_buyer"), division.alias("_division"))
    entry = F.struct(
        F.col("publication_date").isNotNull().alias("dated"),
        (-F.unix_date("publication_date")).alias("age"),
        "code", "title", "buyer_name", "cpv_code", "base_amount").alias("e")
    by_division = _divisions(tenders.filter("cpv_code is not null").select(division.alias("_division"), entry), limit + 1)
    by_buyer = _as_lists(_leading(
        tenders.filter("buyer_name is not null").select(F.col("buyer_name").alias("_buyer"), entry),
        "_buyer", 2 * limit + 1), "_buyer")
    joined = asked.join(by_division.withColumnRenamed("es", "near"), "_division", "left").join(
        by_buyer.withColumnRenamed("es", "same_buyer"), "_buyer", "left")

    def scored(score: int):
        return lambda e: F.struct(
            F.lit(-score).alias("order"), e["dated"].alias("dated"), e["age"].alias("age"), e["code"].alias("code"),
            e["title"].alias("title"), e["buyer_name"].alias("buyer_name"), e["cpv_code"].alias("cpv_code"),
            e["base_amount"].alias("base_amount"))

    none = F.array().cast(by_division.schema["es"].dataType)
    near = F.filter(F.coalesce("near", none), lambda e: e["code"] != F.col("source_code"))
    others = F.filter(F.coalesce("same_buyer", none), lambda e: (e["code"] != F.col("source_code")) & ~F.coalesce(
        e["cpv_code"].startswith(F.col("_division")), F.lit(False)))
    answer = F.slice(F.array_sort(F.concat(F.transform(near, scored(2)), F.transform(others, scored(1)))), 1, limit)
    return joined.select("source_code", F.posexplode(answer).alias("_pos", "_r")).select(
        "source_code", (F.col("_pos") + 1).alias("rank"), "_r.code", "_r.title", "_r.buyer_name", "_r.cpv_code",
        "_r.base_amount", (-F.col("_r.order")).alias("similarity_score"))


def _divisions(df: DataFrame, n: int) -> DataFrame:
    """First n entries of every CPV division, and of the shorter prefixes a malformed code may ask
    for; the latter are taken from the former, which hold few rows."""
    own = _leading(df, "_division", n)
    key = F.col("_division")
    shorter = F.transform(F.sequence(F.lit(0), F.length(key)), lambda i: F.substring(key, F.lit(1), i))
    return _as_lists(_leading(own.select(F.explode(shorter).alias("_division"), "e"), "_division", n), "_division")


def _leading(df: DataFrame, key: str, n: int) -> DataFrame:
    """The first n entries per key, cut in every task before the shuffle."""
    order = Window.partitionBy(key).orderBy(F.asc("e.dated"), F.asc("e.age"), F.asc("e.code"))
    return df.withColumn("_n", F.row_number().over(order)).filter(F.col("_n") <= n).drop("_n")


def _as_lists(df: DataFrame, key: str) -> DataFrame:
    """One row per key with its few entries as an array ``es``."""
    return df.groupBy(key).agg(F.collect_list("e").alias("es"))


def same_buyer_and_cpv(tenders: DataFrame, code: str, one: DataFrame | None = None) -> DataFrame:
    """Other tenders of the buyer and CPV code of one; see ``related_tenders`` for ``one``."""
    one = tenders.filter(F.col("code") == code) if one is None else one
    wanted = one.select(F.struct("buyer_name", "cpv_code")).scalar()
    buyer, cpv = wanted["buyer_name"], wanted["cpv_code"]
    return (
        tenders.filter((F.col("code") != code) & (F.col("buyer_name") == buyer) & (F.col("cpv_code") == cpv))
        .select("code", "title", "publication_date", "base_amount").orderBy(*latest_first()))


def label_counts(vertices: Mapping[str, DataFrame], edges: Mapping[str, DataFrame]) -> DataFrame:
    """``nodes_<Label>`` per vertex table and ``relationships_total``: (stat, n).

    A table given more than once, such as children that are vertices and hold the edge to their
    parent, is counted once and its count enters every stat it belongs to.
    """
    stats: dict[int, tuple[DataFrame, list[str]]] = {}
    for name, df in [*((f"nodes_{label}", df) for label, df in vertices.items()),
                     *(("relationships_total", df) for df in edges.values())]:
        stats.setdefault(id(df), (df, []))[1].append(name)
    counted = None
    for df, names in stats.values():
        one = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(names).alias("stats"), "n")
        counted = one if counted is None else counted.unionByName(one)
    if counted is None:
        raise ValueError("no table to count")
    return counted.select(F.explode("stats").alias("stat"), "n").groupBy("stat").agg(F.sum("n").alias("n"))


def edge_scan(edges: Mapping[str, DataFrame]) -> DataFrame:
    """All edges as (type, src, dst); each input has columns src and dst."""
    result = None
    for name, df in edges.items():
        part = df.select(F.lit(name).alias("type"), F.col("src").cast("string").alias("src"),
                         F.col("dst").cast("string").alias("dst"))
        result = part if result is None else result.unionByName(part)
    return result


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("tender_code").agg(F.count(F.lit(1)).alias("chunk_count"))


def top_by_chunks(tenders: DataFrame, chunks: DataFrame, limit: int = 10) -> DataFrame:
    counted = tenders.select("code", "title").join(chunk_counts(chunks), F.col("code") == F.col("tender_code"), "left")
    return (counted.select("code", "title", F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"))
            .orderBy(F.desc("chunk_count"), "code").limit(limit))


def common_texts(
    chunks: DataFrame, tender_codes: Sequence[str] | None = None, section: str = "requirements",
    at_least: int = 2, limit: int = 10,
) -> DataFrame:
    """Previews that occur under several tenders, most frequent first, one row per tender:
    (requirement_text, frequency, tender_code)."""
    wanted = chunks.filter(F.col("section_type") == section)
    if tender_codes is not None:
        wanted = wanted.filter(F.col("tender_code").isin(list(tender_codes)))
    # without null texts, which never join, both uses below share one shuffle of the pairs
    pairs = wanted.select(preview("text").alias("requirement_text"), "tender_code").filter("requirement_text is not null").distinct()
    top = (pairs.groupBy("requirement_text").agg(F.count(F.lit(1)).alias("frequency"))
           .filter(F.col("frequency") >= at_least).orderBy(F.desc("frequency"), "requirement_text").limit(limit))
    # at most ``limit`` rows of 200 characters on the broadcast side
    return pairs.join(F.broadcast(top), "requirement_text").select("requirement_text", "frequency", "tender_code")


def buyer_portfolio(tenders: DataFrame, chunks: DataFrame, buyer: str = "") -> DataFrame:
    """Per buyer: tenders, budget, distinct CPV codes and chunks. Chunks are counted per tender
    first, so the budget is not multiplied by them."""
    matching = tenders.filter(icontains("buyer_name", buyer))
    joined = matching.join(chunk_counts(chunks), F.col("code") == F.col("tender_code"), "left")
    per_cpv = joined.groupBy("buyer_name", "cpv_code").agg(
        F.count(F.lit(1)).alias("n"), F.sum("base_amount").alias("amount"), F.sum("chunk_count").alias("chunks"))
    return per_cpv.groupBy(F.col("buyer_name").alias("buyer")).agg(
        F.sum("n").alias("total_tenders"), F.sum("amount").alias("total_budget"),
        F.count("cpv_code").alias("n_cpv_codes"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("total_chunks"))


def portfolio_cpv_codes(tenders: DataFrame, buyer: str = "") -> DataFrame:
    return tenders.filter(icontains("buyer_name", buyer)).select(F.col("buyer_name").alias("buyer"), "cpv_code").distinct()


def section_histogram(chunks: DataFrame, tender_code: str | None = None) -> DataFrame:
    if tender_code is not None:
        chunks = chunks.filter(F.col("tender_code") == tender_code)
    return (chunks.groupBy(F.col("section_type").alias("section")).agg(F.count(F.lit(1)).alias("chunk_count"))
            .orderBy(F.desc("chunk_count"), "section"))


def orphan_chunks(chunks: DataFrame, tenders: DataFrame) -> DataFrame:
    return chunks.join(tenders.select(F.col("code").alias("tender_code")), "tender_code", "left_anti")


def index_health(tenders: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: totals, orphaned chunks and mean chunks per tender.

    Both sides are counted by code in one grouping, so each table is read once. A chunk without a
    code, or whose code no tender has, is orphaned.
    """
    none = F.lit(0).cast("long")
    per_code = tenders.groupBy("code").agg(F.count(F.lit(1)).alias("tenders")).withColumn("chunks", none).unionByName(
        chunk_counts(chunks).select(F.col("tender_code").alias("code"), none.alias("tenders"), F.col("chunk_count").alias("chunks")))
    met = per_code.groupBy("code").agg(F.sum("tenders").alias("tenders"), F.sum("chunks").alias("chunks"))
    orphaned = F.when((F.col("tenders") == 0) | F.col("code").isNull(), F.col("chunks"))
    return met.agg(
        F.coalesce(F.sum("tenders"), none).alias("total_tenders"), F.coalesce(F.sum("chunks"), none).alias("total_chunks"),
        F.coalesce(F.sum(orphaned), none).alias("orphaned_chunks"),
    ).withColumn("avg_chunks_per_tender", F.col("total_chunks") / F.greatest("total_tenders", F.lit(1)))


def timeline(tenders: DataFrame, prefix: str, start: str, end: str) -> DataFrame:
    return (
        tenders.filter(F.col("cpv_code").startswith(prefix)
                       & F.col("publication_date").between(F.to_date(F.lit(start)), F.to_date(F.lit(end))))
        .select("code", "title", F.col("publication_date").alias("date"), F.col("base_amount").alias("amount"),
                F.col("buyer_name").alias("buyer"))
        .orderBy(F.desc_nulls_first("date"), "code"))


def tender_deadlines(deadlines: DataFrame, code: str) -> DataFrame:
    return (deadlines.filter(F.col("tender_code") == code).select("type", "date", "notes")
            .orderBy(F.asc_nulls_last("date"), "type", "notes"))


def mandatory_requirements(tenders: DataFrame, lots: DataFrame, requirements: DataFrame,
                           code: str | None = None) -> DataFrame:
    """Tender, lot, mandatory requirement: the two-edge chain."""
    if code is not None:
        tenders, lots = tenders.filter(F.col("code") == code), lots.filter(F.col("tender_code") == code)
    needed = requirements.filter("mandatory").select(F.col("id").alias("requirement_id"), "description")
    return (lots.select("tender_code", F.col("name").alias("lot_name"), F.col("id").alias("lot_id"), "requirement_id")
            .join(needed, "requirement_id")
            .join(tenders.select(F.col("code").alias("tender_code"), "title"), "tender_code")
            .select("tender_code", "title", "lot_id", "lot_name", "requirement_id", "description"))


def requirement_sections(chain: DataFrame, mentioned_in: DataFrame) -> DataFrame:
    """Third edge: requirement to the chunk that states it (columns requirement_id, chunk_id)."""
    return chain.join(mentioned_in, "requirement_id")


def tenders_classified(tenders: DataFrame, classified_as: DataFrame, prefix: str, limit: int = 10) -> DataFrame:
    classes = classified_as.filter(F.col("cpv_division").startswith(prefix))
    return (tenders.join(classes, "code").select("code", "title", "base_amount", "publication_date")
            .orderBy(*latest_first()).limit(limit))


def entities_of_chunks(edges: DataFrame, chunk_ids: DataFrame) -> DataFrame:
    """Entities linked to the given chunks in either direction of the edge (src, dst)."""
    # an edge is read once and turned both ways inside its row
    ways = F.array(F.struct(F.col("dst").alias("chunk_id"), F.col("src").alias("entity")),
                   F.struct(F.col("src").alias("chunk_id"), F.col("dst").alias("entity")))
    both = edges.select(F.inline(ways))
    return both.join(chunk_ids.select("chunk_id").distinct(), "chunk_id", "left_semi").distinct()


def reachable(edges: DataFrame, sources: DataFrame, max_depth: int | None = None) -> DataFrame:
    """Everything reachable over one or more edges: (source, node, depth), shortest depth.

    A breadth-first expansion: each round joins only the newest nodes to the edges and drops what
    was seen, so cycles end. Every round is written to the checkpoint folder.
    """
    edges = edges.select("src", "dst").filter("src is not null and dst is not null")
    frontier = sources.select(F.col("id").alias("source"), F.col("id").alias("node")).distinct()
    seen: DataFrame | None = None
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(edges, F.col("node") == F.col("src")).select("source", F.col("dst").alias("node")).distinct()
        if seen is not None:
            found = found.join(seen.select("source", "node"), ["source", "node"], "left_anti")
        found = cut_lineage(found.withColumn("depth", F.lit(depth)))
        if found.isEmpty():
            break
        seen = found if seen is None else seen.unionByName(found)
        frontier = found.select("source", "node")
    return seen if seen is not None else frontier.withColumn("depth", F.lit(0)).filter("false")


def add_lots(lots: DataFrame, new_lots: DataFrame, tenders: DataFrame) -> DataFrame:
    """Append lots whose tender exists; the others are silently left out."""
    known = tenders.select(F.col("code").alias("tender_code"))
    return lots.unionByName(new_lots.join(known, "tender_code", "left_semi"), allowMissingColumns=True)


def create_tenders(tenders: DataFrame, new_tenders: DataFrame) -> DataFrame:
    """Append tender vertices; the date arrives as ISO text and only the six known properties stay."""
    dated = new_tenders.select(*[
        F.to_date("publication_date").alias(c) if c == "publication_date" else F.col(c) for c in TENDER_COLUMNS])
    return tenders.unionByName(dated, allowMissingColumns=True)


def chunk_vertices(chunks: DataFrame, tenders: DataFrame) -> DataFrame:
    """Chunk vertices (with their HAS_CHUNK parent) for all chunks of known tenders in one append."""
    known = tenders.select(F.col("code").alias("tender_code"))
    return chunks.join(known, "tender_code", "left_semi").select(
        "id", "tender_code", preview("text").alias("text_preview"),
        F.coalesce(F.col("metadata")["page_number"].cast("int"), F.lit(0)).alias("page_number"),
        F.coalesce(F.col("metadata")["chunk_index"].cast("int"), F.lit(0)).alias("chunk_index"))


def detach_delete(vertices: DataFrame, children: Mapping[str, DataFrame], codes: DataFrame,
                  key: str = "code", edge_key: str = "tender_code") -> tuple[DataFrame, dict[str, DataFrame]]:
    """Delete vertices by key together with their incident edges (the child keeps existing, unlinked)."""
    gone = codes.select(F.col(key).alias("_gone")).distinct()
    kept = vertices.join(gone, F.col(key) == F.col("_gone"), "left_anti")
    unlinked = {
        name: df.join(gone, F.col(edge_key) == F.col("_gone"), "left")
        .withColumn(edge_key, F.when(F.col("_gone").isNull(), F.col(edge_key))).drop("_gone")
        for name, df in children.items()}
    return kept, unlinked


def clear(*tables: DataFrame, confirm: bool = False) -> list[DataFrame]:
    """Empty every table, keeping schemas; refuses without ``confirm=True``."""
    if not confirm:
        raise ValueError("Must set confirm=True to clear database")
    return [df.filter("false") for df in tables]


def constraint_violations(vertices: DataFrame, property_name: str, constraint_type: str = "UNIQUE") -> DataFrame:
    if constraint_type != "UNIQUE":
        raise ValueError(f"Constraint type {constraint_type} not yet supported")
    return duplicate_keys(vertices.filter(F.col(property_name).isNotNull()), property_name)


def write_counters(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """Rows created, deleted and changed between two versions of a keyed table."""
    values = [c for c in before.columns if c != key and c in after.columns]
    old = before.select(F.col(key), F.struct(*values).alias("_old"), F.lit(True).alias("_had"))
    new = after.select(F.col(key), F.struct(*values).alias("_new"), F.lit(True).alias("_has"))
    joined = old.join(new, key, "full_outer")
    return joined.agg(
        F.count_if(F.col("_had").isNull()).alias("created"),
        F.count_if(F.col("_has").isNull()).alias("deleted"),
        F.count_if(F.col("_had") & F.col("_has") & ~F.col("_old").eqNullSafe(F.col("_new"))).alias("changed"))
