"""Documents to blocks, sections and token chunks.

A document is one row from end to end: blocks, headings and windows are arrays of that row, so
chunking is a narrow transformation with no shuffle and no group to hold in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from bidlake.functions.arrays import let, scan
from bidlake.functions.text import tokens

MAX_TOKENS = 800
MIN_TOKENS = 400
OVERLAP_TOKENS = 120

# Markup stripped before reading blocks, block tags, tags that end a run of text
# between blocks, and character entities.
_HIDDEN_MARKUP = r"(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->"
_BLOCK_MARKUP = (
    r"(?is)<h[1-6][^>]*>.*?</h[1-6]>|<p(?: [^>]*)?>.*?</p>|<li[^>]*>.*?</li>|<table[^>]*>.*?</table>"
)
_CONTAINER_MARKUP = (
    r"(?is)</?(?:address|article|aside|blockquote|body|dd|div|dl|dt|figcaption|figure|footer|form|head|header|hr|html"
    r"|main|nav|ol|p|pre|section|title|ul)(?:[ \t\r\n][^>]*)?/?>"
)
_CUT = "\u0001"
_ENTITIES = (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&amp;", "&"))


def _keyed(df: DataFrame, id_column: str) -> tuple[DataFrame, str]:
    """Chunks get a column ``id`` of their own, so a document's ``id`` becomes ``document_id``."""
    if id_column != "id":
        return df, id_column
    return df.withColumnRenamed("id", "document_id"), "document_id"


def _spans(n: Column, size: int, overlap: int, min_tokens: int) -> Column:
    """(start, length) of each window over n tokens; a last window shorter than ``min_tokens``
    is given to its predecessor."""
    step = size - overlap
    starts = F.when(
        n > 0, F.sequence(F.lit(0), F.greatest(n - overlap - 1, F.lit(0)), F.lit(step))
    ).otherwise(F.array().cast("array<int>"))
    if min_tokens:
        starts = F.filter(starts, lambda s: (s == 0) | (n - s >= min_tokens))
        last = F.array_max(starts)
        return F.transform(starts, lambda s: F.struct(
            s.alias("start"), F.when(s == last, n - s).otherwise(F.lit(size)).alias("length")))
    return F.transform(starts, lambda s: F.struct(s.alias("start"), F.least(n - s, F.lit(size)).alias("length")))


def token_chunks(
    df: DataFrame,
    id_column: str,
    text_column: str,
    size: int = MAX_TOKENS,
    overlap: int = OVERLAP_TOKENS,
    min_tokens: int = 0,
    with_text: bool = True,
) -> DataFrame:
    """Overlapping windows of whitespace tokens, one row each.

    Adds ``id`` (``<id>-<index>``; an ``id`` of the document becomes ``document_id``), ``chunk_index``, ``token_start``, ``n_tokens`` and, unless
    ``with_text=False``, ``text``; the other columns are kept. Only the finished windows are
    exploded: the token array of a long document is never copied per window.
    """
    if not 0 <= overlap < size:
        raise ValueError("overlap must be at least 0 and below size")
    df, id_column = _keyed(df, id_column)
    kept = [c for c in df.columns if c != text_column]
    tokenised = df.select(*kept, tokens(text_column).alias("_tokens"))
    spans = tokenised.select(
        *kept, *(["_tokens"] if with_text else []),
        _spans(F.size("_tokens"), size, overlap, min_tokens).alias("_spans"))
    if with_text:
        windows = F.transform("_spans", lambda s: F.struct(
            s["start"].alias("start"), s["length"].alias("length"),
            F.array_join(F.slice(F.col("_tokens"), s["start"] + 1, s["length"]), " ").alias("text")))
    else:
        # exploding a bare column would infer a size filter that tokenises the text a second time
        windows = F.transform("_spans", lambda s: F.struct(s["start"].alias("start"), s["length"].alias("length")))
    rows = spans.select(*kept, F.posexplode(windows).alias("chunk_index", "_window"))
    return rows.select(
        F.concat(F.col(id_column).cast("string"), F.lit("-"), F.col("chunk_index").cast("string")).alias("id"),
        *kept, "chunk_index",
        F.col("_window.start").alias("token_start"), F.col("_window.length").alias("n_tokens"),
        *([F.col("_window.text").alias("text")] if with_text else []),
    )


def _plain(markup: Column) -> Column:
    text = F.regexp_replace(markup, r"(?s)<[^>]*>", " ")
    for entity, char in _ENTITIES:
        text = F.replace(text, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(text, "[ \\t\\n\\r]+", " "))


def html_blocks(df: DataFrame, html_column: str, page_number: int = 1) -> DataFrame:
    """Replace an HTML column by ``blocks``: array of (page_number, type, level, text).

    Headings, paragraphs, list items and tables keep their type; any other text becomes paragraphs,
    cut at container tags. Everything stays in document order.
    """
    visible = F.regexp_replace(F.regexp_replace(html_column, _HIDDEN_MARKUP, " "), _CUT, " ")
    # blocks stand at odd places, what lies between them at even ones
    pieces = F.split(F.regexp_replace(visible, f"({_BLOCK_MARKUP})", f"{_CUT}$1{_CUT}"), _CUT)
    kept = [c for c in df.columns if c != html_column]

    def tagged(piece: Column, i: Column) -> Column:
        # one character splits without a pattern, which a split would compile for every piece
        inner = F.transform(F.split(F.regexp_replace(piece, _CONTAINER_MARKUP, _CUT), _CUT), lambda x: F.struct(F.lit("").alias("tag"), x.alias("markup")))
        whole = F.array(F.struct(F.lower(F.substring(piece, 2, 2)).alias("tag"), piece.alias("markup")))
        return F.when(i % 2 == 1, whole).otherwise(inner)

    def block(piece: Column) -> Column:
        tag = piece["tag"]
        level = F.when(tag.rlike("^h[1-6]$"), F.substring(tag, 2, 1).cast("int"))
        kind = (F.when(level.isNotNull(), "heading").when(tag == "li", "list_item")
                .when(tag == "ta", "table").otherwise("paragraph"))
        return F.struct(F.lit(page_number).alias("page_number"), kind.alias("type"), level.alias("level"),
                        _plain(piece["markup"]).alias("text"))

    blocks = F.transform(F.flatten(F.transform(pieces, tagged)), block)
    return df.select(*kept, F.filter(blocks, lambda b: b["text"] != "").alias("blocks"))


def page_blocks(df: DataFrame, pages_column: str = "pages") -> DataFrame:
    """Flatten parsed pages into one ``blocks`` array in reading order; blocks keep all their fields."""
    kept = [c for c in df.columns if c != pages_column]
    fields = df.schema[pages_column].dataType.elementType["blocks"].dataType.elementType.fieldNames()
    flat = F.flatten(F.transform(pages_column, lambda p: F.transform(p["blocks"], lambda b: F.struct(
        p["page_number"].alias("page_number"), *[b[f].alias(f) for f in fields if f != "page_number"]))))
    return df.select(*kept, flat.alias("blocks"))


def section_chunks(df: DataFrame, id_column: str, blocks_column: str = "blocks") -> DataFrame:
    """One row per heading-delimited section of a document with a ``blocks`` array.

    Columns: ``id``, ``title``, ``heading_level``, ``section_path`` (titles of the open headings
    joined by `` > ``), ``text`` (blocks after the heading, tables included), ``blocks``,
    ``page_numbers``, ``section_index``. Blocks before the first heading form a section without
    title.
    """
    df, id_column = _keyed(df, id_column)
    kept = [c for c in df.columns if c != blocks_column]

    def cuts(blocks: Column) -> Column:
        # positions of headings, with position 0 added when the document opens without one
        flagged = F.transform(blocks, lambda b, i: F.struct(i.alias("at"), ((i == 0) | (b["type"] == "heading")).alias("cut")))
        return F.transform(F.filter(flagged, lambda x: x["cut"]), lambda x: x["at"])

    def sections(blocks: Column, starts: Column, paths: Column) -> Column:
        ends = F.concat(F.slice(starts, 2, F.greatest(F.size(starts) - 1, F.lit(0))), F.array(F.size(blocks)))
        return F.transform(F.arrays_zip(starts.alias("start"), ends.alias("end"), paths.alias("path")), lambda x, k: section(blocks, x, k))

    def section(blocks: Column, at: Column, k: Column) -> Column:
        start, length = at["start"], at["end"] - at["start"]
        head = F.get(blocks, start)
        titled = head["type"] == "heading"
        span = F.slice(blocks, start + 1, length)
        body = F.when(titled, F.slice(blocks, start + 2, length - 1)).otherwise(span)
        return F.struct(
            k.alias("section_index"),
            F.when(titled, head["text"]).alias("title"),
            F.when(titled, F.coalesce(head["level"], F.lit(1))).otherwise(0).alias("heading_level"),
            at["path"].alias("section_path"),
            F.array_join(F.transform(body, lambda b: b["text"]), "\n").alias("text"),
            span.alias("blocks"),
            F.array_sort(F.array_distinct(F.transform(span, lambda b: b["page_number"]))).alias("page_numbers"),
        )

    found = let(F.col(blocks_column), lambda blocks: let(cuts(blocks), lambda starts: let(
        _open_titles(blocks, starts), lambda paths: F.when(F.size(blocks) > 0, sections(blocks, starts, paths)))))
    rows = df.select(*kept, F.explode(found).alias("_section"))
    return rows.select(
        F.concat(F.col(id_column).cast("string"), F.lit("#"), F.col("_section.section_index").cast("string")).alias("id"),
        *kept, "_section.*")


def _open_titles(blocks: Column, starts: Column) -> Column:
    """Path of every section: a scan over its headings that keeps one open title per level."""
    levels = range(1, 7)

    def opened(open_: Column, head: Column) -> Column:
        level = F.when(head["type"] == "heading", F.coalesce(head["level"], F.lit(1)))
        return F.array(*[
            F.when(level.isNull() | (level > i), F.get(open_, F.lit(i - 1)))
            .when(level == i, head["text"]) for i in levels])

    heads = F.transform(starts, lambda at: let(F.get(blocks, at), lambda b: F.struct(b["type"].alias("type"), b["level"].alias("level"), b["text"].alias("text"))))
    empty = F.array(*[F.lit(None).cast("string") for _ in levels])
    return scan(heads, empty, opened, lambda open_, head: F.array_join(F.array_compact(opened(open_, head)), " > "),
                "array<string>", "string")


def document_chunks(
    df: DataFrame, id_column: str, size: int = MAX_TOKENS, overlap: int = OVERLAP_TOKENS,
    min_tokens: int | None = None, blocks_column: str = "blocks",
) -> DataFrame:
    """Blocks to token chunks in the stored shape: sections first, then windows inside each.

    ``min_tokens`` is as in ``token_chunks``; by default ``MIN_TOKENS``, or none where windows are no
    larger than that. Titles lead the text of their section, so a section that is only a heading still counts.
    """
    if min_tokens is None:
        min_tokens = MIN_TOKENS if size > MIN_TOKENS else 0
    df, id_column = _keyed(df, id_column)
    sections = section_chunks(df, id_column, blocks_column).select(
        F.col("id").alias("source_chunk_id"), F.col(id_column).alias("document_id"),
        "section_path", "page_numbers",
        F.concat_ws("\n", "title", F.nullif("text", F.lit(""))).alias("text"))
    return token_chunks(sections, "source_chunk_id", "text", size, overlap, min_tokens).select(
        "id", "text", "section_path",
        F.create_map(
            F.lit("chunk_index"), F.col("chunk_index").cast("string"),
            F.lit("page_number"), F.coalesce(F.get("page_numbers", F.lit(0)), F.lit(0)).cast("string"),
        ).alias("metadata"),
        "page_numbers", "source_chunk_id", "document_id", "chunk_index", "n_tokens")


def merge_similar_paragraphs(
    df: DataFrame, id_column: str, paragraphs_column: str, vectors_column: str,
    threshold: float = 0.8, max_tokens: int = 1024,
) -> DataFrame:
    """Semantic chunks: neighbouring paragraphs stay together while their cosine similarity is at
    least ``threshold`` and the chunk stays within ``max_tokens``.

    Paragraphs and their unit vectors come as two arrays of one row; the scan, whose state is the
    number of tokens in the open chunk, runs in that row.
    """
    df, id_column = _keyed(df, id_column)
    kept = [c for c in df.columns if c not in (paragraphs_column, vectors_column)]

    def cosine(a: Column, b: Column) -> Column:
        def inner(x: Column, y: Column) -> Column:
            return F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, z: s + z)
        both = F.sqrt(inner(a, a)) * F.sqrt(inner(b, b))
        return F.when(both > 0, inner(a, b) / both).otherwise(0.0)

    def items(texts: Column, vectors: Column) -> Column:
        """Per paragraph its tokens and whether it is like the one before."""
        before = F.concat(F.array(F.lit(None).cast("array<double>")), F.slice(vectors, 1, F.greatest(F.size(vectors) - 1, F.lit(0))))
        alike = F.zip_with(before, vectors, lambda a, b: F.coalesce(cosine(a, b) >= threshold, F.lit(False)))
        return F.zip_with(F.transform(texts, lambda x: F.size(tokens(x))), alike, lambda n, a: F.struct(n.alias("n"), a.alias("alike")))

    def joins(open_: Column, item: Column) -> Column:
        return F.coalesce(item["alike"] & (open_ + item["n"] <= max_tokens), F.lit(False))

    def chunks(texts: Column, counted: Column) -> Column:
        joined = scan(counted, F.lit(0), lambda s, x: F.when(joins(s, x), s + x["n"]).otherwise(x["n"]), joins, "int", "boolean")
        starts = F.transform(F.filter(F.transform(joined, lambda j, i: F.struct(i.alias("at"), j.alias("joined"))), lambda x: ~x["joined"]),
                             lambda x: x["at"])
        return let(starts, lambda at: F.zip_with(
            at, F.concat(F.slice(at, 2, F.greatest(F.size(at) - 1, F.lit(0))), F.array(F.size(texts))),
            lambda a, b: F.struct(
                F.array_join(F.slice(texts, a + 1, b - a), "\n").alias("text"),
                F.aggregate(F.slice(counted, a + 1, b - a), F.lit(0), lambda s, x: s + x["n"]).alias("tokens"))))

    both = F.struct(F.col(paragraphs_column).alias("texts"), F.col(vectors_column).cast("array<array<double>>").alias("vectors"))
    merged = let(both, lambda x: let(items(x["texts"], x["vectors"]), lambda counted: F.when(
        F.size(x["texts"]) > 0, chunks(x["texts"], counted))))
    return df.select(*kept, F.posexplode(merged).alias("chunk_index", "_chunk")).select(
        F.concat(F.col(id_column).cast("string"), F.lit("-"), F.col("chunk_index").cast("string")).alias("id"),
        *kept, "chunk_index", "_chunk.text", F.col("_chunk.tokens").alias("n_tokens"))
