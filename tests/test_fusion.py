"""Fusion against a plain restatement on lists, and the context operators."""

import random

import pytest
from pyspark.sql import functions as F

from bidlake.operators import fusion

SCHEMA = "qid int, ord int, id string, source_chunk_id string, score double, side string"


def restated(vector, keyword, alpha):
    """Best-scoring row per key, in order of score and then of first appearance."""
    seen = {}
    known = [h["score"] for h in vector if h["score"] is not None]
    largest = max(known) if known else 1.0
    scored = [(h, alpha * (h["score"] / largest if largest else 0.0)) for h in vector]
    scored += [(h, 1 - alpha) for h in keyword]
    for hit, score in scored:
        key = hit["id"] or hit["source_chunk_id"]
        if key is not None and (key not in seen or score > seen[key][1]):
            seen[key] = (hit, score)
    return sorted(((k, round(s, 9), h["side"]) for k, (h, s) in seen.items()), key=lambda x: -x[1])


def lists(rng):
    def hit(side, i):
        ident = rng.choice(["a", "b", "c", "d", "", None])
        score = rng.choice([0.0, 0.5, 0.3, -0.4, 0.9, 0.3 / 0.7]) if side == "v" else None
        return {"ord": i, "id": ident, "source_chunk_id": rng.choice(["a", "x", None]), "score": score, "side": side}
    return ([hit("v", i) for i in range(rng.randint(0, 6))], [hit("k", i) for i in range(rng.randint(0, 6))])


def test_max_fusion_equals_restatement(spark):
    rng = random.Random(7)
    cases = [lists(rng) for _ in range(150)]

    def frame(which):
        rows = [(q, h["ord"], h["id"], h["source_chunk_id"], h["score"], h["side"])
                for q, case in enumerate(cases) for h in case[which]]
        return spark.createDataFrame(rows, SCHEMA)

    found = fusion.hybrid_fusion(frame(0), frame(1), 0.7).withColumn(
        "key", F.coalesce(F.nullif("id", F.lit("")), "source_chunk_id"))
    by_query = {}
    for r in found.orderBy("qid", "rank").collect():
        by_query.setdefault(r.qid, []).append((r.key, round(r.score, 9), r.side))
    for q, (vector, keyword) in enumerate(cases):
        assert by_query.get(q, []) == restated(vector, keyword, 0.7), (q, vector, keyword)


def hits(spark, rows):
    return spark.createDataFrame(rows, "qid int, ord int, id string, score double")


def test_sum_fusion_and_unknown_mode(spark):
    vector = hits(spark, [(0, 1, "a", 0.9), (0, 2, "b", 0.45), (0, 3, "b", 0.9)])
    keyword = hits(spark, [(0, 1, "b", None), (0, 2, "c", None), (0, 3, "c", None)])
    got = [(r.id, round(r.score, 6)) for r in fusion.hybrid_fusion(vector, keyword, mode="sum").orderBy("rank").collect()]
    assert got == [("b", 1.0), ("a", 0.7), ("c", 0.3)]
    with pytest.raises(ValueError):
        fusion.hybrid_fusion(vector, keyword, mode="mean")


def test_largest_score_zero_and_negative(spark):
    empty = hits(spark, []).filter("false")
    zero = fusion.hybrid_fusion(hits(spark, [(0, 1, "a", 0.0), (0, 2, "b", -1.0)]), empty)
    assert [r.score for r in zero.collect()] == [0.0, 0.0]
    negative = fusion.hybrid_fusion(hits(spark, [(0, 1, "a", -0.5), (0, 2, "b", -1.0)]), empty).orderBy("rank")
    assert [(r.id, round(r.score, 6)) for r in negative.collect()] == [("b", 1.4), ("a", 0.7)]


def test_budget_is_a_greedy_prefix(spark):
    rows = spark.createDataFrame(
        [(0, 1, "one two"), (0, 2, "a b c d e"), (0, 3, "x"), (1, 1, "p q r")], "qid int, rank int, text string")
    kept = fusion.within_budget(rows, 3).select("qid", "rank").collect()
    assert sorted(map(tuple, kept)) == [(0, 1), (1, 1)]


def test_rerank_boost_and_grouping(spark):
    rows = spark.createDataFrame([
        (0, 1, "t1", 0.50, "2024-01-01", 10.0, "other"), (0, 2, "t2", 0.48, "2025-06-01", 2e6, "requirements"),
        (0, 3, "t1", 0.47, None, None, None)],
        "qid int, rank int, tender_code string, score double, publication_date string, base_amount double, section_type string")
    boosted = fusion.rerank(rows, 2, fusion.rescored(fusion.metadata_boost())).orderBy("rank").collect()
    assert [(r.tender_code, round(r.score, 4)) for r in boosted] == [("t2", 0.624), ("t1", 0.5)]
    order = fusion.group_by_tender(rows).orderBy("position").collect()
    assert [(r.tender_code, r["rank"], r.tender_position) for r in order] == [("t1", 1, 1), ("t1", 3, 1), ("t2", 2, 2)]
    assert fusion.confidence(rows.filter("false")).count() == 0


def test_best_per_id(spark):
    rows = spark.createDataFrame([(0, "a", 0.2), (0, "a", 0.9), (0, "b", 0.9)], "qid int, id string, score double")
    got = [(r.id, r.score, r.n_variants, r["rank"]) for r in fusion.best_per_id(rows).orderBy("rank").collect()]
    assert got == [("a", 0.9, 2, 1), ("b", 0.9, 1, 2)]
