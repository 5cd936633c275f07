"""Ranked trigram profiles."""

import collections
import zlib

from pyspark.sql import functions as F

from bidlake.functions import language
from bidlake.functions.language import detect_language, language_profiles, ranked_trigrams, trigrams


def plain(text, size=300):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = f" {' '.join(words)} " if words else ""
    counted = collections.Counter(s[i:i + 3] for i in range(len(s) - 2))
    return sorted(counted, key=lambda g: (-counted[g], g.encode()))[:size]


TEXTS = [None, "", " \n", "a", "The cat; the hat!", "Über Ärger, über Öl", "日本語 テスト", "12 34", "x" * 5000, "und " * 400]


def test_trigrams_are_ranked_inside_the_row(spark):
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for r in df.select("id", ranked_trigrams("text").alias("g"), ranked_trigrams("text", 3).alias("few"), F.size(trigrams("text")).alias("n")).collect():
        assert r.g == plain(TEXTS[r.id]) and r.few == plain(TEXTS[r.id], 3) and r.n >= len(r.g)


def test_rows_without_letters_or_ids(spark):
    learnt = spark.createDataFrame([("en", "the hat and the cat"), ("de", "der hut und die katze"), (None, "zzz")], "lang string, text string")
    profiles = language_profiles(learnt, "lang", "text")
    assert {r.lang for r in profiles.select("lang").distinct().collect()} == {"en", "de"}
    rows = [(1, "the cat"), (1, "und der hut"), (None, "the the"), (2, None), (3, ""), (4, "123"), (5, "qqq")]
    got = detect_language(spark.createDataFrame(rows, "id int, text string"), profiles, "id", "text").collect()
    assert sorted(map(tuple, got), key=str) == sorted(
        [(1, "en"), (1, "de"), (None, "en"), (2, None), (3, None), (4, None), (5, None)], key=str)
    assert detect_language(spark.createDataFrame([], "id int, text string"), profiles, "id", "text").count() == 0


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    held = {r.doc_id for r in docs.select("doc_id").collect() if zlib.crc32(str(r.doc_id).encode()) % 3 == 1}
    profiles = language_profiles(docs.filter(~F.col("doc_id").isin(held)), "lang", "text")
    found = detect_language(docs.filter(F.col("doc_id").isin(held)), profiles, "doc_id", "text").join(docs, "doc_id").select("lang", "detected").collect()
    assert sum(r.lang == r.detected for r in found) >= 0.95 * len(found) > 100


def test_letters_are_not_handled_as_array_items(spark):
    # a text's letters as array items of Spark, one string each, took most of the time
    df = spark.createDataFrame(list(enumerate(TEXTS)), "id int, text string")
    for found in (trigrams("text"), ranked_trigrams("text")):
        plan = df.select(found)._jdf.queryExecution().optimizedPlan().toString()
        assert "lambdafunction" not in plan and "split(" not in plan


def test_profiles_do_not_depend_on_the_steps(spark, monkeypatch):
    texts = [(lang, text) for lang in ("en", "de") for text in [*TEXTS, "\U00020000\U00010400 \U0001d4d0"]]
    learnt = spark.createDataFrame(texts, "lang string, text string").coalesce(1)
    whole = sorted(map(tuple, language_profiles(learnt, "lang", "text").collect()))
    monkeypatch.setattr(language, "STEP_LETTERS", 3)
    assert sorted(map(tuple, language_profiles(learnt, "lang", "text").collect())) == whole
    counted = collections.Counter(g for _, text in texts[:len(TEXTS) + 1] for g in grams_of(text))
    best = sorted(counted, key=lambda g: (-counted[g], g.encode()))[:300]
    assert [g for lang, g, _ in sorted(whole, key=lambda r: (r[0], r[2])) if lang == "en"] == best


def grams_of(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split()
    s = f" {' '.join(words)} " if words else ""
    return [s[i:i + 3] for i in range(len(s) - 2)]
