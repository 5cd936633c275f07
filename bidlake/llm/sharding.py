"""Sharding by extendible hashing.

A document hashes to ``HASH_BITS`` bits. A bucket is a prefix of these bits; one that holds more than
the byte limit is split on its next bit, all others stay, until every bucket fits. Bytes are summed
once per ``STEP_BITS`` more bits, only inside buckets that are still too large, and the depth of every
bucket is the smallest at which its prefix fits: what splitting one bucket at a time arrives at.
Rows that no bit can part (repeated rows, or one document above the limit) go to pages of one bucket
at full depth.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import stage

BYTE_LIMIT = 1 << 20
HASH_BITS = 48
STEP_BITS = 12


def _prefix(bits: int, hashed: str = "hash"):
    return F.shiftright(F.col(hashed), HASH_BITS - bits)


def directory(hashed: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """(prefix at ``at`` bits, at, depth, shard_bytes, shard_docs): one row per cell of the directory;
    cells of one bucket agree in their first ``depth`` bits. ``hashed`` has hash and n_bytes."""
    done = None
    open_ = hashed
    base = 0
    while True:
        at = base + STEP_BITS
        cells = stage(open_.groupBy(_prefix(at).alias("cell")).agg(
            F.sum("n_bytes").alias("bytes"), F.count("*").alias("docs")), "cells")
        levels = cells.withColumn("depth", F.explode(F.sequence(F.lit(base), F.lit(at))))
        prefix = F.expr(f"shiftright(cell, {at} - depth)")
        sums = levels.groupBy("depth", prefix.alias("prefix")).agg(
            F.sum("bytes").alias("shard_bytes"), F.sum("docs").alias("shard_docs")).filter(F.col("shard_bytes") <= limit)
        fits = levels.withColumn("prefix", prefix).join(sums, ["depth", "prefix"]).groupBy("cell").agg(
            F.min_by(F.struct("depth", "shard_bytes", "shard_docs"), "depth").alias("s"))
        found = stage(fits.select("cell", F.lit(at).alias("at"), "s.*"), "directory")
        done = found if done is None else done.unionByName(found)
        large = cells.filter(F.col("bytes") > limit).select("cell")
        if large.isEmpty():
            return done
        if at >= HASH_BITS:
            whole = large.join(cells, "cell").select(
                "cell", F.lit(at).alias("at"), F.lit(HASH_BITS).alias("depth"), F.col("bytes").alias("shard_bytes"),
                F.col("docs").alias("shard_docs"))
            return done.unionByName(whole)
        open_ = open_.join(large, _prefix(at) == F.col("cell"), "left_semi")
        base = at


def shard(docs: DataFrame, limit: int = BYTE_LIMIT) -> DataFrame:
    """doc_id, n_bytes, depth, shard (the bits of its bucket), page, shard_bytes, shard_docs per row.

    ``page`` is 0 unless the bucket is at full depth and above the limit; then each page holds rows
    of one size within the limit (or one row above it), and shard_bytes and shard_docs count the
    whole bucket. A null text has no bytes, a null doc_id hashes as an empty string, repeated rows
    are placed each, no rows give no rows. Other columns are not read.
    """
    key = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    hashed = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce(F.octet_length(F.col("text").cast("string")), F.lit(0)).cast("long").alias("n_bytes"),
        F.conv(F.substring(key, 1, HASH_BITS // 4), 16, 10).cast("long").alias("hash"),
        F.spark_partition_id().alias("part")), "hashed")
    cells = stage(directory(hashed, limit), "cells")
    steps = [r["at"] for r in cells.select("at").distinct().collect()]  # at most HASH_BITS / STEP_BITS
    if not steps:
        return _result(hashed.withColumns({"depth": F.lit(0), "shard_bytes": F.lit(0).cast("long"),
                                           "shard_docs": F.lit(0).cast("long"), "page": F.lit(0).cast("long")}))
    placed = None
    for at in sorted(steps):
        here = hashed.withColumn("cell", _prefix(at)).join(cells.filter(F.col("at") == at).drop("at"), "cell").drop("cell")
        placed = here if placed is None else placed.unionByName(here)
    over = (F.col("depth") == HASH_BITS) & (F.col("shard_bytes") > limit)
    order = Window.partitionBy("hash", "n_bytes", "part").orderBy("doc_id")
    each = F.greatest(F.floor(F.lit(limit) / F.greatest("n_bytes", F.lit(1))), F.lit(1))
    nth = F.floor((F.row_number().over(order) - 1) / each)
    paged = placed.filter(over).withColumn("page", 1 + F.pmod(F.xxhash64("n_bytes", "part", nth), F.lit((1 << 62) - 1)))
    return _result(placed.filter(~over).withColumn("page", F.lit(0).cast("long")).unionByName(paged))


def _result(placed: DataFrame) -> DataFrame:
    bits = F.substring(F.lpad(F.conv(F.col("hash").cast("string"), 10, 2), HASH_BITS, "0"), F.lit(1), F.col("depth"))
    return placed.select("doc_id", "n_bytes", F.col("depth").cast("int").alias("depth"), bits.alias("shard"), "page",
                         "shard_bytes", "shard_docs")
