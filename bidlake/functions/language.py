"""Language detection by ranked character n-grams.

A profile is the list of the most frequent trigrams of a language; a text is compared by how far its own
ranked trigrams lie out of place in each profile, and takes the nearest language. A text's trigrams are
counted inside its row, as numbers in numpy, and at most ``PROFILE`` of them leave it; grouping, ranking
and the comparison with the profiles are Spark's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.session import cut_lineage

PROFILE = 300
# Profiles are broadcast up to this many rows (some 300 languages of two bytes to a letter).
BROADCAST_ROWS = 100_000
# Letters counted in one numpy step; a longer text is one step.
STEP_LETTERS = 2_000_000
# A trigram as one number: a code point has 21 bits, so numbers sort like their trigrams in UTF-8.
_BITS = 21
_LETTER = (1 << _BITS) - 1


def _framed(text: str | Column) -> Column:
    """The lower-cased words of a text, a blank at both ends of each; null without a letter."""
    text = F.col(text) if isinstance(text, str) else text
    plain = F.btrim(F.regexp_replace(F.lower(text), "[^\\p{L}]+", " "))
    return F.when(plain != "", F.concat(F.lit(" "), plain, F.lit(" ")))


def _codes(framed: str | None) -> np.ndarray:
    letters = np.frombuffer((framed or "").encode("utf-32-le"), np.uint32).astype(np.int64)
    return letters[:-2] << 2 * _BITS | letters[1:-1] << _BITS | letters[2:]


def _grams(codes: np.ndarray) -> pa.Array:
    letters = np.stack([codes >> 2 * _BITS, codes >> _BITS & _LETTER, codes & _LETTER], axis=1).astype(np.uint32)
    return pa.array(letters.view("<U3").ravel(), type=pa.string())


def _lists(codes: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, codes)])
    return pa.ListArray.from_arrays(pa.array(ends, type=pa.int32()), _grams(np.concatenate([*codes, np.zeros(0, np.int64)])))


def trigrams(text: str | Column) -> Column:
    """Character trigrams of the lower-cased words of a text, a blank at both ends of each; none for a null text."""
    def found(texts: pa.Array) -> pa.Array:
        return _lists([_codes(s) for s in texts.to_pylist()])

    return F.arrow_udf(found, T.ArrayType(T.StringType()))(_framed(text))


def ranked_trigrams(text: str | Column, size: int = PROFILE) -> Column:
    """The most frequent trigrams of a text, most frequent first, ties in order of the trigram."""
    def first(framed: str | None) -> np.ndarray:
        codes, n = np.unique(_codes(framed), return_counts=True)
        return codes[np.argsort(-n, kind="stable")[:size]]

    def ranked(texts: pa.Array) -> pa.Array:
        return _lists([first(s) for s in texts.to_pylist()])

    return F.arrow_udf(ranked, T.ArrayType(T.StringType()))(_framed(text))


def language_profiles(texts: DataFrame, language: str, text: str, size: int = PROFILE) -> DataFrame:
    """(lang, gram, rank) of the most frequent trigrams of each language; texts without one are left out.

    The profiles are computed once and kept in the checkpoint folder.
    """
    rows = texts.filter(F.col(language).isNotNull()).select(F.col(language).alias("lang"), _framed(text).alias("framed"))
    schema = T.StructType([rows.schema["lang"], T.StructField("gram", T.StringType()), T.StructField("n", T.LongType())])

    def counted(held: dict[int, list[np.ndarray]], languages: pa.Array) -> Iterator[pa.RecordBatch]:
        for i, codes in held.items():
            grams, n = np.unique(np.concatenate(codes), return_counts=True)
            named = languages.take(pa.array(np.full(len(grams), i)))
            yield pa.RecordBatch.from_arrays([named, _grams(grams), pa.array(n, type=pa.int64())], names=schema.names)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            coded = batch.column(0).dictionary_encode()
            held: dict[int, list[np.ndarray]] = {}
            letters = 0
            for i, framed in zip(coded.indices.to_pylist(), batch.column(1)):
                held.setdefault(i, []).append(_codes(framed.as_py()))
                letters += len(held[i][-1])
                if letters >= STEP_LETTERS:
                    yield from counted(held, coded.dictionary)
                    held, letters = {}, 0
            yield from counted(held, coded.dictionary)

    grams = rows.mapInArrow(partial, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    return cut_lineage(grams.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= size).select("lang", "gram", "rank"))


def detect_language(texts: DataFrame, profiles: DataFrame, id_column: str, text: str, size: int = PROFILE) -> DataFrame:
    """(id, detected) per row of ``texts``: the language with the nearest profile, ties to the smaller name.

    Texts that share no trigram with any profile (null, empty and wordless ones too) have null. Rows with
    equal or null ids are judged each.
    """
    few = profiles.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rows = texts.select(F.monotonically_increasing_id().alias("_row"), F.col(id_column).alias("_id"), ranked_trigrams(text, size).alias("_grams"))
    placed = rows.select("_row", "_id", F.posexplode_outer("_grams").alias("_at", "gram"))
    met = placed.join(F.broadcast(profiles) if few else profiles, "gram", "left")
    # trigrams missing from a profile lie ``size`` places off; taking that from every one met leaves the order as it is
    off = F.sum(F.abs(F.col("_at") + 1 - F.col("rank")) - size)
    by_language = met.groupBy("_row", "_id", "lang").agg(off.alias("off"))
    nearest = F.min(F.when(F.col("lang").isNotNull(), F.struct("off", "lang")))
    return by_language.groupBy("_row", "_id").agg(nearest["lang"].alias("detected")).select(F.col("_id").alias(id_column), "detected")
