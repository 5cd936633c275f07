"""Graph patterns on small tables with nulls, ties, gaps and cycles."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from bidlake.operators import graph

TENDER = "code string, title string, cpv_code string, base_amount double, buyer_name string, publication_date date"


@pytest.fixture(scope="module")
def tenders(spark):
    day = dt.date
    return spark.createDataFrame([
        ("a", "A", "72000000", 1.0, "Comune Roma", day(2024, 1, 1)),
        ("b", "B", "72100000", 2.0, "Comune Roma", None),
        ("c", "C", None, 3.0, "COMUNE roma", day(2025, 1, 1)),
        ("d", "D", "45000000", 4.0, "Comune Roma", day(2023, 1, 1)),
        ("e", "E", "7", 5.0, None, day(2022, 1, 1)),
    ], TENDER)


@pytest.fixture(scope="module")
def lots(spark):
    return spark.createDataFrame(
        [("l1", "a", "x", "1", 10.0), ("l2", "a", "y", "2", None), ("l3", "d", "z", "3", 5.0)],
        "id string, tender_code string, name string, cpv_code string, base_amount double")


def test_unknown_dates_lead(tenders):
    assert [r.code for r in graph.tenders_by_cpv(tenders, "72").collect()] == ["b", "a"]
    assert [r.code for r in graph.tenders_by_buyer(tenders, "ROMA").collect()] == ["b", "c", "a", "d"]
    assert graph.tenders_by_cpv(tenders, "").count() == 4
    assert graph.tender_by_code(tenders, "zz").count() == 0


def test_tender_without_lots_has_zero_totals(tenders, lots):
    rows = {r.code: r for r in graph.tenders_with_lots(tenders, lots).collect()}
    assert (rows["a"].lot_count, rows["a"].total_lots_amount) == (2, 10.0)
    assert (rows["c"].lot_count, rows["c"].total_lots_amount) == (0, 0.0)
    assert graph.tenders_with_lots(tenders, lots, "c").count() == 1
    pairs = sorted((r.code, r.lot_id) for r in graph.tender_lot_rows(tenders, lots).fillna("-", ["lot_id"]).collect())
    assert pairs == [("a", "l1"), ("a", "l2"), ("b", "-"), ("c", "-"), ("d", "l3"), ("e", "-")]


def test_related_score_order_and_null_fall_through(tenders):
    got = [(r.code, r.similarity_score) for r in graph.related_tenders(tenders, "a").collect()]
    assert got == [("b", 2), ("d", 1)]
    assert [(r.code, r.similarity_score) for r in graph.related_tenders(tenders, "e").collect()] == [("b", 2), ("a", 2)]
    assert graph.related_tenders(tenders, "none").count() == 0
    assert graph.related_tenders(tenders, "c").count() == 0


def test_related_many_equals_one_by_one(spark):
    rng = random.Random(3)
    rows = []
    for i in range(60):
        cpv = rng.choice(["72000000", "72000000", "72000000", "45000000", "33", "3", "", None, f"{i:08d}"])
        buyer = rng.choice(["x", "x", "y", None, f"b{i % 7}"])
        date = rng.choice([None, dt.date(2024, 1, rng.randint(1, 5))])
        rows.append((f"t{i:02d}", f"T{i}", cpv, float(i), buyer, date))
    tenders = spark.createDataFrame(rows, TENDER)
    many = {}
    for r in graph.related_tenders_many(tenders, limit=4).orderBy("source_code", "rank").collect():
        many.setdefault(r.source_code, []).append((r.code, r.similarity_score))

    def brute(source):
        scored = []
        for code, _, cpv, _, buyer, date in rows:
            if code == source[0]:
                continue
            near = cpv is not None and source[2] is not None and cpv.startswith(source[2][:2])
            score = 2 if near else 1 if buyer is not None and buyer == source[4] else 0
            if score:
                scored.append((-score, date is not None, -(date.toordinal() if date else 0), code))
        return [(s[3], -s[0]) for s in sorted(scored)[:4]]

    for row in rows:
        assert many.get(row[0], []) == brute(row), row
    some = tenders.filter("code in ('t00', 't07')")
    assert {r.source_code for r in graph.related_tenders_many(tenders, some, 4).collect()} <= {"t00", "t07"}


def test_related_many_cuts_before_the_shuffle(tenders):
    plan = graph.related_tenders_many(tenders)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan and "CartesianProduct" not in plan and "NestedLoop" not in plan


def test_reachable_ends_on_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("c", "d"), ("x", "y"), ("d", None)], "src string, dst string")
    start = spark.createDataFrame([("a",), ("x",)], "id string")
    got = sorted(map(tuple, graph.reachable(edges, start).collect()))
    assert got == [("a", "a", 3), ("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("x", "y", 1)]
    assert graph.reachable(edges, start, 1).count() == 2
    assert graph.reachable(edges, start.filter("id = 'none'")).count() == 0


def test_context_ignores_unknown_and_repeated_ids(spark, tenders):
    chunks = spark.createDataFrame([("k1", "a"), ("k2", "b"), ("k3", "gone")], "id string, tender_code string")
    ids = spark.createDataFrame([("k1",), ("k1",), ("k3",), ("zz",)], "id string")
    rows = graph.chunk_context(ids, chunks, tenders).collect()
    assert [(r.chunk_id, r.tender_title) for r in rows] == [("k1", "A")]


def test_context_of_every_chunk(spark, tenders):
    chunks = spark.createDataFrame([("k1", "a"), ("k1", "a"), ("k3", "gone")], "id string, tender_code string")
    rows = graph.chunk_context(None, chunks, tenders).collect()
    assert [(r.chunk_id, r.tender_title) for r in rows] == [("k1", "A")] * 2
    assert sorted(map(str, rows)) == sorted(map(str, graph.chunk_context(chunks, chunks, tenders).collect()))


def test_portfolio_does_not_multiply_the_budget(spark, tenders):
    chunks = spark.createDataFrame([(str(i), "a") for i in range(5)], "id string, tender_code string")
    row = graph.buyer_portfolio(tenders, chunks, "Comune Roma").filter("buyer = 'Comune Roma'").first()
    assert (row.total_tenders, row.total_budget, row.n_cpv_codes, row.total_chunks) == (3, 7.0, 3, 5)


def test_stats_and_health(spark, tenders, lots):
    chunks = spark.createDataFrame([("k1", "a"), ("k2", "zz")], "id string, tender_code string")
    stats = {r.stat: r.n for r in graph.label_counts({"Tender": tenders, "Lot": lots}, {"HAS_LOT": lots, "HAS_CHUNK": chunks}).collect()}
    assert stats == {"nodes_Tender": 5, "nodes_Lot": 3, "relationships_total": 5}
    row = graph.index_health(tenders, chunks).first()
    assert (row.total_tenders, row.total_chunks, row.orphaned_chunks, row.avg_chunks_per_tender) == (5, 2, 1, 0.4)
    assert graph.index_health(tenders.filter("false"), chunks.filter("false")).first().avg_chunks_per_tender == 0


def test_writes(spark, tenders, lots):
    new = spark.createDataFrame([("n1", "a"), ("n2", "nope")], "id string, tender_code string")
    assert [r.id for r in graph.add_lots(lots, new, tenders).filter("id like 'n%'").collect()] == ["n1"]
    made = spark.createDataFrame([("z", "Z", "1", 1.0, "b", "2025-01-15", "x")], TENDER.replace("date date", "date string") + ", extra string")
    row = graph.create_tenders(tenders, made).filter("code = 'z'").first()
    assert row.publication_date == dt.date(2025, 1, 15) and "extra" not in row.asDict()
    kept, unlinked = graph.detach_delete(tenders, {"Lot": lots}, tenders.filter("code = 'a'"))
    assert kept.count() == 4 and unlinked["Lot"].filter("tender_code is null").count() == 2
    chunks = spark.createDataFrame(
        [("k", "a", "x" * 300, {"page_number": "4"}), ("m", "a", None, None), ("o", "?", "t", None)],
        "id string, tender_code string, text string, metadata map<string,string>")
    rows = {r.id: r for r in graph.chunk_vertices(chunks, tenders).collect()}
    assert len(rows["k"].text_preview) == 200 and (rows["k"].page_number, rows["k"].chunk_index) == (4, 0)
    assert rows["m"].text_preview == "" and "o" not in rows
    counters = graph.write_counters(tenders, tenders.filter("code <> 'a'").withColumn("title", F.lit("A")), "code").first()
    assert (counters.created, counters.deleted, counters.changed) == (0, 1, 4)


def test_clear_and_constraints(tenders, lots):
    with pytest.raises(ValueError):
        graph.clear(tenders)
    assert graph.clear(tenders, lots, confirm=True)[0].count() == 0
    assert graph.constraint_violations(lots, "tender_code").collect()[0].n == 2
    with pytest.raises(ValueError, match="not yet supported"):
        graph.constraint_violations(lots, "id", "EXISTS")


def test_common_texts_and_entities(spark):
    chunks = spark.createDataFrame(
        [("1", "a", "same", "requirements"), ("2", "b", "same", "requirements"), ("3", "b", "same", "requirements"),
         ("4", "c", "own", "requirements"), ("5", "c", "same", "other")],
        "id string, tender_code string, text string, section_type string")
    rows = sorted(map(tuple, graph.common_texts(chunks).collect()))
    assert rows == [("same", 2, "a"), ("same", 2, "b")]
    assert graph.common_texts(chunks, ["a", "c"]).count() == 0
    edges = spark.createDataFrame([("r1", "k1"), ("k1", "d1"), ("r2", "k2")], "src string, dst string")
    got = graph.entities_of_chunks(edges, spark.createDataFrame([("k1",)], "chunk_id string"))
    assert sorted(r.entity for r in got.collect()) == ["d1", "r1"]
