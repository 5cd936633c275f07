"""Mixing sources to target weights by Pareto order sampling.

Targets: sources by code point (null last) weigh ``WEIGHTS`` in turn and share the words of the whole
table; a source stops at ``MAX_REPEAT`` times its own words and the rest is shared anew by weight.
Every document is wanted target / words of its source times (times its importance, where a column
is named). The whole part of that number are certain copies. The fraction p is an inclusion
probability: with a uniform u per document, documents rank by (u / (1 - u)) / (p / (1 - p)), and the
first ones whose words come nearest to what the target still lacks get one copy more.

The cut in the ranking needs no sort of a source: words are summed by the leading 12 bits of the
rank, then by the next 12 bits inside the one bucket that the cut falls in, and only the documents
of the bucket that is left are ordered.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.llm.common import WORD, stage

WEIGHTS = (5, 2, 1)
MAX_REPEAT = 3
BUCKETS = 4096
SALTS = 32
SEED = "mix-1|"


def source_targets(totals: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT) -> DataFrame:
    """(source, words) with its ``target``; one row per source, so one task orders the names."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(weights)
    weighed = totals.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (turn + 1).cast("int")).cast("double"))
    weighed = weighed.withColumn("full_at", max_repeat * F.col("words") / F.col("weight"))
    everything = Window.partitionBy()
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    ahead = order.rowsBetween(Window.unboundedPreceding, -1)
    # the level at which the sources not yet full share what the full ones leave
    level = (F.sum("words").over(everything) - max_repeat * F.coalesce(F.sum("words").over(ahead), F.lit(0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(ahead), F.lit(0.0)))
    levelled = weighed.withColumn("level", level).withColumn("ok", F.col("level") <= F.col("full_at"))
    water = F.min(F.when(F.col("ok"), F.col("full_at"))).over(everything)
    shared = F.max(F.when(F.col("ok") & (F.col("full_at") == F.col("water")), F.col("level"))).over(everything)
    out = levelled.withColumn("water", water).withColumn("shared", shared)
    target = F.when(F.col("full_at") < F.col("water"), max_repeat * F.col("words").cast("double")).otherwise(
        F.least(F.col("shared") * F.col("weight"), max_repeat * F.col("words").cast("double")))
    return out.select("source", "words", F.coalesce(target, F.lit(0.0)).alias("target"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, max_repeat: int = MAX_REPEAT,
        importance: str | None = None, seed: str = SEED, key: str | None = None) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken (= copies * size) per row of ``docs``.

    ``docs`` has doc_id, source, text. Size is the number of words; a null text has none and is taken
    with no words. A null source is a source of its own. Equal doc_ids draw equal numbers; rows that
    also agree in size are interchangeable. No rows give no rows. ``importance`` names a positive
    column; documents it would lift above ``max_repeat`` copies stop there. ``key`` names a column that
    every row of the result carries as ``row_key``.
    """
    carried = [F.col(key).alias("row_key")] if key else []
    kept = ["row_key"] if key else []
    wish = F.col(importance).cast("double") if importance else F.lit(1.0)
    draw = F.conv(F.substring(F.md5(F.concat(F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))), 1, 13), 16, 10)
    sized = stage(docs.select(
        F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"),
        F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        wish.alias("wish"), ((draw.cast("double") + 0.5) / float(1 << 52)).alias("u"), *carried), "sized")
    totals = sized.groupBy("source").agg(F.sum("size").alias("words"), F.sum(F.col("wish") * F.col("size")).alias("wished"))
    targets = source_targets(totals, weights, max_repeat).join(
        totals.select(F.col("source").alias("s2"), "wished"), F.col("source").eqNullSafe(F.col("s2")))
    # a hot source meets its one row of totals in SALTS parts
    salted = targets.select("source", F.col("words").alias("source_size"), "target", "wished",
                            F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salt = F.pmod(F.xxhash64("doc_id", "u"), F.lit(SALTS)).cast("int")
    left, right = sized.withColumn("salt", salt).alias("l"), salted.alias("r")
    joined = left.join(right, (F.col("l.salt") == F.col("r.salt")) & F.col("l.source").eqNullSafe(F.col("r.source")))
    rate = F.when(F.col("wished") > 0, F.col("target") * F.col("wish") / F.col("wished")).otherwise(0.0)
    drawn = joined.select("doc_id", "l.source", "size", "source_size", "target", "u", F.least(rate, F.lit(float(max_repeat))).alias("rate"), *kept)
    p = F.col("rate") - F.floor("rate")
    rank = F.when(p > 0, F.col("u") * (1 - p) / (F.col("u") * (1 - p) + (1 - F.col("u")) * p))
    ranked = stage(drawn.select(
        "doc_id", "source", "size", "source_size", "target", F.floor("rate").alias("whole"), rank.alias("rank"),
        F.floor(rank * BUCKETS).alias("b1"), F.floor(rank * (BUCKETS * BUCKETS)).alias("b2"), *kept), "ranked")

    lacking = ranked.groupBy("source").agg((F.first("target") - F.sum(F.col("whole") * F.col("size"))).alias("lack"))
    first = _cut(ranked.filter("rank is not null"), "b1", lacking.withColumn("ahead", F.lit(0)))
    inside = _inside(ranked, first, "b1")
    second = _cut(inside, "b2", first.select("source", "lack", "ahead"))
    last = _inside(inside, second, "b2")
    order = Window.partitionBy("source").orderBy("rank", "doc_id", "size", *kept)
    before = F.col("ahead") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("size")
    close = last.join(_plain(second), F.col("source").eqNullSafe(F.col("s2"))).withColumn(
        "more", (2 * before + F.col("size") <= 2 * F.col("lack")).cast("int"))

    cuts = _plain(first).select("s2", F.col("b1").alias("c1"), F.col("all_in")).join(
        _plain(second).select(F.col("s2").alias("s3"), F.col("b2").alias("c2")), F.col("s2").eqNullSafe(F.col("s3")), "left")
    salted_cuts = cuts.select("s2", "c1", "c2", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt2"))
    rest = ranked.withColumn("salt", F.pmod(F.xxhash64("doc_id", "rank"), F.lit(SALTS)).cast("int")).join(
        salted_cuts, (F.col("salt") == F.col("salt2")) & F.col("source").eqNullSafe(F.col("s2")), "left")
    closing = F.coalesce((F.col("b1") == F.col("c1")) & (F.col("b2") == F.col("c2")), F.lit(False))
    more = F.when(F.col("b1") < F.col("c1"), 1).when((F.col("b1") == F.col("c1")) & (F.col("b2") < F.col("c2")), 1).otherwise(0)
    rest = rest.filter(~closing).withColumn("more", more)
    columns = ["doc_id", "source", "size", "source_size", "target", *kept]
    copies = (F.col("whole") + F.col("more")).cast("long")
    both = rest.select(*columns, copies.alias("copies")).unionByName(close.select(*columns, copies.alias("copies")))
    return both.withColumn("taken", F.col("copies") * F.col("size"))


def _plain(cut: DataFrame) -> DataFrame:
    return cut.withColumnRenamed("source", "s2")


def _cut(rows: DataFrame, bucket: str, lacking: DataFrame) -> DataFrame:
    """Per source the first bucket that the lacking words do not cover whole, with the words ahead
    of it; a source whose words are all covered gets a bucket beyond the last."""
    sums = rows.groupBy("source", bucket).agg(F.sum("size").alias("n"))
    running = F.sum("n").over(Window.partitionBy("source").orderBy(bucket))
    held = sums.withColumn("upto", running).join(_plain(lacking), F.col("source").eqNullSafe(F.col("s2")))
    reached = F.col("ahead") + F.col("upto")
    open_ = reached > F.col("lack")
    out = held.groupBy("source").agg(
        F.first("lack").alias("lack"),
        F.coalesce(F.min(F.when(open_, F.col(bucket))), F.max(bucket) + 1).alias("cut_at"),
        F.max(F.when(~open_, reached)).alias("covered"), F.first("ahead").alias("ahead0"),
        (F.max(F.when(open_, 1)).isNull()).alias("all_in"))
    return out.select("source", "lack", F.coalesce("covered", "ahead0").alias("ahead"), F.col("cut_at").alias(bucket), "all_in")


def _inside(rows: DataFrame, cut: DataFrame, bucket: str) -> DataFrame:
    """The rows in the bucket that the cut falls in: about one in BUCKETS of a source."""
    at = _plain(cut).select("s2", F.col(bucket).alias("cut_at"))
    return rows.join(at, F.col("source").eqNullSafe(F.col("s2")) & (F.col(bucket) == F.col("cut_at")), "left_semi")


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it; rows it does not take are left out.

    All columns stay, whatever their names. Rows are told apart by a number that is written with
    them, so null and repeated doc_ids get what the mix decides for each row. No rows give no rows.
    """
    nested = stage(docs.select(F.monotonically_increasing_id().alias("row_key"), F.struct("*").alias("row")), "rows")
    wish = options.get("importance")
    columns = ["doc_id", "source", "text", *([wish] if wish else [])]
    read = nested.select("row_key", *(F.col("row").getField(c).alias(c) for c in dict.fromkeys(columns)))
    wanted = mix(read, key="row_key", **options).filter("copies > 0").select("row_key", "copies")
    return nested.join(wanted, "row_key").select(
        "row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select("row.*")
