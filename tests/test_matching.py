"""Matching inside groups against brute force."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.operators import matching

ROWS = "tender_code string, id int, embedding array<float>, key string, vector int"


@pytest.fixture(scope="module")
def groups():
    """Seven groups, one of which holds most rows; some rows lack a vector or group."""
    rng = np.random.default_rng(12)
    rows = []
    for i in range(300):
        group = None if i % 41 == 0 else "hot" if i % 3 else f"g{i % 7}"
        vector = None if i % 37 == 0 else [float(x) for x in rng.normal(size=6).astype(np.float32)]
        rows.append((group, i, vector, "clash", 1))
    rows += [("hot", 1000 + i, rows[1][2], "clash", 1) for i in range(20)]
    return rows


@pytest.fixture(scope="module")
def table(spark, groups):
    return spark.createDataFrame(groups, ROWS).repartition(4).cache()


def dot(a, b):
    return float(np.rint(np.dot(np.array(a, float), np.array(b, float)) * 1e9) / 1e9)


@pytest.mark.parametrize(("block", "metric"), [(matching.BLOCK_ROWS, "IP"), (7, "IP"), (25, "L2")])
def test_nearest_within_equals_brute_force(spark, groups, table, block, metric):
    rng = np.random.default_rng(13)
    asked = [(g, q, [float(x) for x in rng.normal(size=6)]) for g in ("hot", "g1", "g3", "nowhere", None) for q in range(9)]
    asked.append(("g1", 99, None))
    queries = spark.createDataFrame(asked, "tender_code string, qid int, query_vector array<double>")
    got = matching.nearest_within(queries, table, "tender_code", 4, metric, block_rows=block).collect()
    for g, q, v in asked:
        rows = [r for r in groups if g is not None and v is not None and r[0] == g and r[2] is not None]
        score = {r[1]: dot(r[2], v) if metric == "IP" else float(np.rint(((np.array(r[2], float) - v) ** 2).sum() * 1e9) / 1e9) for r in rows}
        want = sorted(score, key=lambda i: (score[i] if metric == "L2" else -score[i], i))[:4]
        mine = sorted((r for r in got if r.tender_code == g and r.qid == q), key=lambda r: r["rank"])
        assert [r.id for r in mine] == want and [r.score for r in mine] == pytest.approx([score[i] for i in want])
    assert len(got) == 3 * 9 * 4


def test_scores_below_the_limit_go(spark, table):
    queries = spark.createDataFrame([("hot", 1, [1.0, 0.0, 0.0, 0.0, 0.0, 0.0])], "tender_code string, qid int, query_vector array<double>")
    rows = matching.nearest_within(queries, table, "tender_code", 200, min_score=0.5, block_rows=20).collect()
    assert 0 < len(rows) < 200 and all(r.score > 0.5 for r in rows)


@pytest.mark.parametrize("block", [matching.BLOCK_ROWS, 9])
def test_late_interaction_equals_brute_force(spark, groups, table, block):
    names = ["hot", "g1", "g2", "g3"]
    pairs = [(a, b) for a in names for b in names if a != b] + [("g1", "nowhere")]
    chunks = table.filter("embedding is not null").select(
        F.col("tender_code").alias("owner"), "id", F.col("embedding").cast("array<double>").alias("vector"))
    got = {(r.source, r.target): r.score for r in matching.late_interaction(
        spark.createDataFrame(pairs, "source string, target string"), chunks, block).collect()}
    held = {n: [r[2] for r in groups if r[0] == n and r[2] is not None] for n in names}
    want = {(a, b): sum(max(dot(x, y) for y in held[b]) for x in held[a]) for a, b in pairs if b in held and held[a] and held[b]}
    assert got == pytest.approx(want, abs=1e-6)


def test_similar_tenders_keep_to_their_filters(spark, groups, table):
    areas = {"hot": "x", "g1": "x", "g2": "y", "g3": "x", "g4": "x", "g5": "y", "g6": "x", "g0": "x", "empty": "x"}
    tenders = spark.createDataFrame(list(areas.items()), "code string, area string")
    filters = F.to_json(F.struct(F.col("area")))
    rows = matching.similar_tenders(table, tenders, filters, 6, k=2, n_candidates=3, block_rows=50).collect()
    held = {n: [np.array(r[2], float) for r in groups if r[0] == n and r[2] is not None] for n in areas}
    for name, area in areas.items():
        mine = [r.similar for r in sorted((r for r in rows if r.code == name), key=lambda r: r["rank"])]
        if not held[name]:
            assert not mine
            continue
        rivals = [n for n in areas if n != name and areas[n] == area and held[n]]
        mean = {n: np.mean(held[n], axis=0) for n in [name, *rivals]}
        rivals = sorted(rivals, key=lambda n: (-dot(mean[name], mean[n]), n))
        # the tender itself may or may not be among the four nearest means
        near = rivals[:3]
        score = {n: sum(max(dot(x, y) for y in held[n]) for x in held[name]) for n in near}
        assert mine == sorted(near, key=lambda n: (-score[n], n))[:2]


def test_empty_sides(spark, table):
    none = spark.createDataFrame([], "tender_code string, qid int, query_vector array<double>")
    assert matching.nearest_within(none, table, "tender_code").count() == 0
    tenders = spark.createDataFrame([], "code string, area string")
    assert matching.similar_tenders(table, tenders, F.lit(json.dumps({})), 6).count() == 0
