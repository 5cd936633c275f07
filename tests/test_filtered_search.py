"""Batch search with one filter document per question."""

import datetime
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from bidlake.functions.filters import matches
from bidlake.operators import filtered_search
from bidlake.operators.filtered_search import FilterSet, parse_filter, vector_topk_filtered
from bidlake.operators.vector_search import vector_topk

ROWS = ("id string, embedding array<float>, tender_id string, amount double, pages int, due date, tags array<string>, "
        "metadata map<string,string>")
SPECS = [
    None, "", "{}", {"tender_id": "T1"}, {"tender_id": {"$in": ["T2", "T3", None]}}, {"amount": {"$gte": 10, "$lt": 60.5}},
    {"pages": {"$gt": 2.5}}, {"pages": {"$ne": 3}}, {"due": {"$gte": "2025-01-20"}}, {"tags": {"$contains": "red"}},
    {"metadata.kind": "lot"}, {"$or": [{"tender_id": "T1"}, {"$and": [{"pages": 4}, {"amount": {"$lte": 80}}]}]},
    {"tender_id": "nowhere"}, {"tender_id": {"$in": []}}, {"$and": []},
]


@pytest.fixture(scope="module")
def collection(spark):
    rng = np.random.default_rng(8)
    rows = []
    for i in range(400):
        vector = None if i % 50 == 7 else [float(x) for x in rng.normal(size=8).astype(np.float32)]
        rows.append((f"c{i:03d}", vector, None if i % 17 == 0 else f"T{i % 5}", None if i % 13 == 0 else float(i % 90), i % 6,
                     None if i % 11 == 0 else datetime.date(2025, 1, 1) + datetime.timedelta(days=i % 40),
                     None if i % 19 == 0 else ["red"] * (i % 3) + ["blue", None], {"kind": "lot"} if i % 4 else None))
    return spark.createDataFrame(rows, ROWS).repartition(3).cache()


@pytest.fixture(scope="module")
def questions(spark):
    rng = np.random.default_rng(9)
    rows = [(i, [float(x) for x in rng.normal(size=8)], s if s is None or isinstance(s, str) else json.dumps(s)) for i, s in enumerate(SPECS)]
    return spark.createDataFrame(rows + [(99, None, None)], "qid int, query_vector array<double>, filter string")


def one_by_one(collection, questions, k, metric):
    found = {}
    for q in questions.collect():
        if q.query_vector is None:
            continue
        spec = json.loads(q.filter or "{}")
        # a null operand matches nothing, and the integer column is compared as a number
        rows = collection.filter(matches({k: v for k, v in spec.items()})) if spec else collection
        found[q.qid] = [(r.id, r.score) for r in vector_topk(rows, q.query_vector, k, metric).collect()]
    return found


@pytest.mark.parametrize(("limit", "pushed", "block", "step", "metric"), [
    (1 << 20, 16, None, 8192, "IP"), (1 << 20, 0, None, 32, "COSINE"), (1, 0, 5, 8192, "IP"), (1, 0, 150, 16, "L2")])
def test_equals_one_search_per_question(monkeypatch, collection, questions, limit, pushed, block, step, metric):
    monkeypatch.setattr(filtered_search, "PUSHED_FILTERS", pushed)
    monkeypatch.setattr(filtered_search, "STEP_ROWS", step)
    want = one_by_one(collection, questions, 6, metric)
    got = vector_topk_filtered(questions, collection, 6, metric, query_bytes_limit=limit, block_rows=block).collect()
    for qid, hits in want.items():
        mine = sorted((r for r in got if r.qid == qid), key=lambda r: r["rank"])
        assert [(r.id, pytest.approx(r.score)) for r in mine] == hits, qid
        assert [r["rank"] for r in mine] == list(range(1, len(hits) + 1))
    assert {r.qid for r in got} <= set(want)


def test_one_scan_for_all_questions_and_filters_reach_it(spark, tmp_path, collection, questions):
    path = str(tmp_path / "rows")
    collection.write.parquet(path)
    stored = spark.read.parquet(path)
    few = questions.filter("qid in (3, 5)")
    plan = vector_topk_filtered(few, stored, 5)._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan parquet") == 1
    assert "PushedFilters: [" in physical and "EqualTo(tender_id,T1)" in physical[physical.index("PushedFilters"):]


@pytest.mark.parametrize("bad", [
    "{", "[]", '"text"', '{"$nor": []}', '{"a": {"$near": 1}}', '{"$or": []}', '{"$and": {"a": 1}}', '{"a": {"$in": 3}}'])
def test_filters_that_cannot_be_read(bad):
    with pytest.raises(ValueError):
        parse_filter(bad)


def test_equal_atoms_are_one():
    filters = FilterSet(['{"a": 1, "b": 2}', '{"b": 2}', '{"a": {"$eq": 1}, "b": 2}', None])
    assert len(filters.trees) == 3 and len(filters.atoms) == 2
    assert sorted(map(list, filters.questions)) == [[0, 2], [1], [3]]


def test_unknown_field_fails_and_no_questions_give_nothing(spark, collection, questions):
    wrong = questions.limit(1).withColumn("filter", F.lit('{"nothing": 1}'))
    with pytest.raises(Exception, match="nothing"):
        vector_topk_filtered(wrong, collection, 3).collect()
    assert vector_topk_filtered(questions.limit(0), collection, 3).count() == 0
    assert vector_topk_filtered(questions, collection.limit(0), 3).count() == 0
