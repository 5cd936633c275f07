"""Routing questions to strategies and running only those that occur."""

import pytest
from pyspark.sql import functions as F

from bidlake.plans import retrieval


@pytest.fixture
def questions(spark):
    return spark.createDataFrame([
        (1, "Quando scade?", "T1"), (2, "Requisiti obbligatori?", "T1"), (3, "What is it about?", "T2"), (4, None, "T2"), (5, "data dei requisiti", "T9")],
        "qid int, question string, tender_code string")


def branch(name):
    return lambda q: q.select("qid", F.lit(1).alias("rank"), F.concat(F.lit(name), "tender_code").alias("id"), F.lit(name).alias("kind"), F.lit(0.5).alias("score"))


def test_every_question_takes_its_route(questions):
    rows = retrieval.routed_search(questions, {r: branch(r) for r in ("graph_only", "graph_first", "vector_first")}).collect()
    assert {r.qid: (r.route, r.kind) for r in rows} == {
        1: ("graph_only",) * 2, 2: ("graph_first",) * 2, 3: ("vector_first",) * 2, 4: ("vector_first",) * 2, 5: ("graph_only",) * 2}
    assert rows[0].asDict().keys() == {"qid", "route", "rank", "id", "kind", "score"}


def test_unused_branches_are_not_planned(questions):
    def fail(_):
        raise AssertionError("planned")

    only = questions.filter("qid in (3, 4)")
    assert retrieval.routed_search(only, {"graph_only": fail, "graph_first": fail, "vector_first": branch("v")}).count() == 2
    assert retrieval.routed_search(only.limit(0), {"vector_first": branch("v"), "graph_only": fail}).count() == 0
    with pytest.raises(ValueError, match="graph_only"):
        retrieval.routed_search(questions, {"vector_first": branch("v"), "graph_first": branch("g")})


def test_deadlines_and_requirements_of_the_own_tender(spark, questions):
    deadlines = spark.createDataFrame([("T1", "b", "2025-03-01", "x"), ("T1", "a", "2025-01-01", "y"), ("T1", "c", None, "z"), ("T2", "a", "2024-01-01", "w")],
                                      "tender_code string, type string, date string, notes string").withColumn("date", F.to_date("date"))
    found = retrieval.deadlines_of(questions.filter("qid = 1"), deadlines, 3).orderBy("rank").collect()
    assert [r.id for r in found] == ["a 2025-01-01 y", "b 2025-03-01 x", "c z"]
    tenders = spark.createDataFrame([("T1", "one"), ("T2", "two")], "code string, title string")
    lots = spark.createDataFrame([("T1", "l1", "Lot 1", "r1"), ("T1", "l2", "Lot 2", "r1"), ("T1", "l3", "Lot 3", "r2"), ("T2", "l4", "Lot", "r1")],
                                 "tender_code string, id string, name string, requirement_id string")
    needed = spark.createDataFrame([("r1", "d", True), ("r2", "d", False)], "id string, description string, mandatory boolean")
    stated = spark.createDataFrame([("r1", "c2"), ("r1", "c1"), ("r2", "c3")], "requirement_id string, chunk_id string")
    got = retrieval.requirements_of(questions.filter("qid = 2"), tenders, lots, needed, stated, 5).orderBy("rank").collect()
    assert [(r.qid, r.id) for r in got] == [(2, "c1"), (2, "c2")]
