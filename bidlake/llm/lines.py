"""Line dedup: a line found in several documents stays only in the last of them.

Every text is split at line feeds. A line's key is the line without white space at its ends and with
A-Z in lower case. Keys of at least ``min_points`` code points found in at least ``min_docs`` documents
lose all their lines except those of the largest doc_id that holds them.

Only 16 bytes of each key's SHA-256 travel. They are range-partitioned and sorted by hash, then by
document (largest first) and position, so that one stream over a partition meets the document that
keeps a line before all others. The result is a keep bitmap per document, in words of ``WORD_BITS``
lines; words without a dropped line are left out. Texts are read again to apply the bitmaps and meet
them in one join.

A key of very many lines would fill one range, so keys that a frequency sketch (its size is fixed)
reports as frequent are taken out first: their documents are aggregated in every task before they meet,
and their verdicts, one row per key, travel to the lines. Whether a key is taken out changes nothing in
the result.

Defined cases: a null or empty text is one empty line; a null doc_id is one document smaller than all
others; rows of one doc_id are one document, each with its own text; repeated rows get equal results;
an empty table gives no rows. Further columns of the caller travel in one struct, so no name clashes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import shuffle_partitions, stage

MIN_POINTS = 20
MIN_DOCS = 3
WORD_BITS = 64
# A key is frequent if it has more than one line in FREQUENT; at most FREQUENT keys can be so.
FREQUENT = 512
TRACKED = 8192
_BLANKS = " \t\n\x0b\x0c\r"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _lower(key: Column) -> Column:
    """``key`` with A-Z in lower case; only texts of other than one-byte letters need the slow way."""
    return F.when(F.octet_length(key) == F.length(key), F.lower(key)).otherwise(F.translate(key, _UPPER, _LOWER))


def _with_text_key(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc, t1, t2 (two hashes of the text, which tell apart rows of one doc_id), body, row (the caller's)."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    return docs.select(F.col(doc_id).cast("long").alias("doc"), F.xxhash64(body).alias("t1"),
                       F.xxhash64(F.lit("second"), body).alias("t2"), body.alias("body"), F.struct(*docs.columns).alias("row"))


def keyed_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS) -> DataFrame:
    """(doc, t1, t2, pos, key) of every line whose key has at least ``min_points`` code points."""
    rows = _with_text_key(docs, doc_id, text).select("doc", "t1", "t2", F.posexplode(_lines(F.col("body"))).alias("pos", "line"))
    rows = rows.withColumn("line", F.btrim("line", F.lit(_BLANKS))).filter(F.length("line") >= min_points)
    return rows.select("doc", "t1", "t2", "pos", F.unhex(F.substring(F.sha2(_lower(F.col("line")), 256), 1, 32)).alias("key"))


def frequent_keys(lines: DataFrame, frequent: int = FREQUENT, tracked: int = TRACKED) -> list[int]:
    """Hashes of the keys that a sketch of fixed size finds in more than one line of ``frequent``."""
    hashed = lines.select(F.xxhash64("key").alias("h"))
    found = hashed.agg(F.count("*").alias("n"), F.expr(f"approx_top_k(h, {frequent}, {tracked})").alias("top")).first()
    return [e["item"] for e in found["top"] or () if e["count"] * frequent > found["n"]]


def _frequent_drops(lines: DataFrame, min_docs: int) -> DataFrame:
    """Dropped lines among those of a few keys, from aggregates that every task combines first."""
    found = lines.groupBy("key").agg(F.max("doc").alias("hi"), (
        F.count_distinct("doc") + F.max(F.col("doc").isNull().cast("int"))).alias("docs"))
    verdicts = found.filter(F.col("docs") >= min_docs).select("key", "hi")
    earlier = F.coalesce(F.col("doc") < F.col("hi"), F.col("hi").isNotNull())
    return lines.join(F.broadcast(verdicts), "key").filter(earlier).select("doc", "t1", "t2", "pos")


def _streamed_drops(lines: DataFrame, min_docs: int) -> DataFrame:
    """Dropped lines, found in one pass over ranges of hashes sorted by document and position."""
    by_doc = F.col("doc").desc_nulls_last()
    ranges = lines.repartitionByRange(shuffle_partitions(lines.sparkSession), "key").sortWithinPartitions("key", by_doc, "pos")
    group = Window.partitionBy("key")
    ranked = ranges.withColumn("nth", F.dense_rank().over(group.orderBy(by_doc))).withColumn("docs", F.max("nth").over(group))
    return ranked.filter((F.col("docs") >= min_docs) & (F.col("nth") > 1)).select("doc", "t1", "t2", "pos")


def keep_bitmaps(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS,
                 min_docs: int = MIN_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """(doc, t1, t2, n_dropped, words): the keep bitmap of every distinct text that loses a line.

    ``words`` is an array of (word, keep), ascending: bit b of ``keep`` says whether line
    ``WORD_BITS * word + b`` stays. Words of which all lines stay are left out.
    """
    lines = stage(keyed_lines(docs, doc_id, text, min_points), "line-keys")
    hot = frequent_keys(lines, frequent)
    if hot:
        is_hot = F.xxhash64("key").isin(hot)
        drops = _frequent_drops(lines.filter(is_hot), min_docs).unionByName(_streamed_drops(lines.filter(~is_hot), min_docs))
    else:
        drops = _streamed_drops(lines, min_docs)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), F.col("pos") % WORD_BITS)
    words = drops.groupBy("doc", "t1", "t2", (F.col("pos") / WORD_BITS).cast("int").alias("word")).agg(F.bit_or(bit).alias("dropped"))
    return words.groupBy("doc", "t1", "t2").agg(
        F.sum(F.bit_count("dropped")).alias("n_dropped"),
        F.sort_array(F.collect_list(F.struct("word", F.bitwise_not("dropped").alias("keep")))).alias("words"))


def _dense(words: Column) -> Column:
    """The words of a bitmap with the left-out ones up to its last filled in."""
    return F.flatten(F.transform(words, lambda e, i: F.concat(
        F.array_repeat(F.lit(-1).cast("long"), e["word"] - 1 - F.coalesce(F.get(words, i - 1)["word"], F.lit(-1))),
        F.array(e["keep"]))))


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every row of ``docs`` as (row, n_lines, n_dropped, kept): ``row`` is the caller's, ``kept`` the text left."""
    bits = bitmaps.select("doc", "t1", "t2", "n_dropped", _dense(F.col("words")).alias("bits")).alias("b")
    side = _with_text_key(docs, doc_id, text).alias("d")
    same = F.col("d.doc").eqNullSafe(F.col("b.doc")) & (F.col("d.t1") == F.col("b.t1")) & (F.col("d.t2") == F.col("b.t2"))
    found = side.join(bits, same, "left").select("d.row", "d.body", "b.n_dropped", "b.bits")
    shift = (lambda i: F.call_function("shiftrightunsigned", F.get(F.col("bits"), (i / WORD_BITS).cast("int")), i % WORD_BITS))
    left = F.array_join(F.filter(_lines(F.col("body")), lambda line, i: F.coalesce(shift(i).bitwiseAND(1) == 1, F.lit(True))), "\n")
    return found.select(
        "row", F.size(_lines(F.col("body"))).cast("long").alias("n_lines"), F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"),
        F.when(F.col("bits").isNull(), F.col("body")).otherwise(left).alias("kept"))


def dedup_lines(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", min_points: int = MIN_POINTS,
                min_docs: int = MIN_DOCS, frequent: int = FREQUENT) -> DataFrame:
    """(row, n_lines, n_dropped, kept) per row of ``docs``; see ``apply_bitmaps``."""
    bitmaps = stage(keep_bitmaps(docs, doc_id, text, min_points, min_docs, frequent), "line-bitmaps")
    return apply_bitmaps(docs, bitmaps, doc_id, text)
