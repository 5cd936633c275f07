"""Linear passes over arrays, and the operators built on them, on long documents."""

import random
import time

import pytest
from pyspark.sql import functions as F

from bidlake.functions.arrays import let, scan
from bidlake.operators.chunking import merge_similar_paragraphs, section_chunks


@pytest.mark.parametrize("piece", [1, 3, 64])
def test_scan_gives_running_sums(spark, piece):
    rows = [(0, []), (1, [5]), (2, list(range(200))), (3, None)]
    df = spark.createDataFrame(rows, "id int, xs array<int>")
    sums = scan(F.col("xs"), F.lit(0), lambda s, x: s + x, lambda s, x: s * 1000 + x, "int", "int", piece)
    got = {r.id: r.out for r in df.select("id", sums.alias("out")).collect()}
    assert got[0] == [] and got[1] == [5] and got[3] is None
    assert got[2] == [sum(range(i)) * 1000 + i for i in range(200)]


def test_let_binds_once(spark):
    assert spark.range(1).select(let(F.lit(3), lambda x: x * x + x).alias("y")).first().y == 12


def _document(n, seed=0):
    rng = random.Random(seed)
    return [{"page_number": i // 50, "type": "heading" if i % 2 == 0 else "paragraph", "level": rng.choice([1, 2, 3, 4, 6, None]) if i % 2 == 0 else None,
             "text": f"t{i}"} for i in range(n)]


BLOCKS = "id int, blocks array<struct<page_number:int,type:string,level:int,text:string>>"


def test_paths_equal_a_plain_reading(spark):
    blocks = _document(700, 3)
    want, open_ = [], {}
    for b in blocks:
        if b["type"] == "heading":
            level = b["level"] or 1
            open_ = {k: v for k, v in open_.items() if k < level} | {level: b["text"]}
            want.append(" > ".join(open_[k] for k in sorted(open_)))
    rows = section_chunks(spark.createDataFrame([(1, blocks)], BLOCKS), "id").orderBy("section_index").collect()
    assert [r.section_path for r in rows] == want


def _seconds(spark, n):
    df = spark.createDataFrame([(1, _document(2 * n))], BLOCKS).cache()
    df.count()
    start = time.perf_counter()
    assert section_chunks(df, "id").agg(F.count("section_path"), F.sum(F.length("text"))).first()[0] == n
    return time.perf_counter() - start


def test_twice_the_headings_take_about_twice_the_time(spark):
    _seconds(spark, 2000)
    small, large = (min(_seconds(spark, n) for _ in range(2)) for n in (16_000, 32_000))
    assert large < 3 * small + 0.5


def test_merged_paragraphs_equal_a_plain_reading(spark):
    rng = random.Random(6)
    texts = [" ".join(["w"] * rng.randint(0, 9)) for _ in range(400)]
    vectors = [None if rng.random() < 0.05 else rng.choice([[1.0, 0.0], [0.9, 0.1], [0.0, 1.0], [0.0, 0.0]]) for _ in texts]
    chunks, sizes, last = [], [], None
    for text, vector in zip(texts, vectors):
        n = len(text.split())
        alike = last is not None and vector is not None and any(last) and any(vector) and (
            sum(a * b for a, b in zip(last, vector)) / (sum(a * a for a in last) * sum(b * b for b in vector)) ** 0.5 >= 0.8)
        if alike and sizes[-1] + n <= 30:
            chunks[-1] += "\n" + text
            sizes[-1] += n
        else:
            chunks.append(text)
            sizes.append(n)
        last = vector
    df = spark.createDataFrame([(1, texts, vectors), (2, [], []), (3, None, None)], "id int, p array<string>, v array<array<double>>")
    rows = merge_similar_paragraphs(df, "id", "p", "v", max_tokens=30).orderBy("chunk_index").collect()
    assert [(r.text, r.n_tokens) for r in rows] == list(zip(chunks, sizes))
