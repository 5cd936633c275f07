"""Commands, pages, filters, rules and value checks."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from bidlake.functions import text as X
from bidlake.functions import validation as V
from bidlake.functions.filters import matches, optional_equals
from bidlake.operators import relational as R
from bidlake.operators import workflows as W


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([("a", "A", "open", 1.0), ("b", "B", None, 2.0), ("c", "C", "draft", 3.0)],
                                 "id string, title string, status string, amount double")


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_unset_is_not_null(spark, table):
    patches = spark.createDataFrame(
        [("a", ["status"], "ignored", None), ("b", ["title", "status"], "B2", "open"), ("zz", ["title"], "Z", None), ("c", [], "no", "no")],
        "id string, set_fields array<string>, title string, status string")
    assert rows(R.partial_update(table, patches)) == [
        ("a", "A", None, 1.0), ("b", "B2", "open", 2.0), ("c", "C", "draft", 3.0)]


def test_upsert_last_wins(spark, table):
    new = spark.createDataFrame([("b", "x", None, 9.0, 1), ("b", "y", None, 8.0, 2), ("n", "new", "open", 0.0, 1)],
                                "id string, title string, status string, amount double, ord int")
    got = R.upsert(table, new, "id", "ord")
    assert rows(got.select("id", "title")) == [("a", "A"), ("b", "y"), ("c", "C"), ("n", "new")]
    assert R.upsert(table, new.filter("false"), "id", "ord").count() == 3


def test_cascade_and_set_null(spark, table):
    lots = spark.createDataFrame([("l1", "a"), ("l2", "b")], "id string, tender_id string")
    documents = spark.createDataFrame([("d1", "a", "l1"), ("d2", "b", None), ("d3", "b", "l2")],
                                      "id string, tender_id string, lot_id string")
    keys = spark.createDataFrame([("a",)], "id string")
    tenders, left_lots, left_documents = R.delete_tenders(table, lots, documents, keys)
    assert tenders.count() == 2 and rows(left_lots.select("id")) == [("l2",)] and left_documents.count() == 2
    left_lots, updated = R.delete_lots(lots, documents, lots.filter("id = 'l2'"))
    assert left_lots.count() == 1 and rows(updated.filter("lot_id is null").select("id")) == [("d2",), ("d3",)]


def test_pages_and_optional_filters(table):
    assert [r.id for r in R.page(table, "id", limit=1, offset=1).collect()] == ["b"]
    assert R.page(table, "id", status=None).count() == 3
    assert R.page(table, "id", status="open").count() == 1
    envelope = R.page_with_total(table, "id", limit=2).collect()
    assert len(envelope) == 2 and envelope[0].total == 3
    found = R.search_tenders(table.withColumnRenamed("id", "code"), "c", max_budget=0, min_budget=0,
                             text_columns=("title",), budget_column="amount")
    assert [r.code for r in found.collect()] == ["c"]


def test_document_rows_are_reproducible(spark):
    new = spark.createDataFrame([("t1", None, "x.pdf"), ("t1", "l1", "x.pdf")], "tender_id string, lot_id string, filename string")
    first, again = rows(R.document_rows(new, "bucket").select("storage_path")), rows(R.document_rows(new, "bucket").select("storage_path"))
    assert first == again and len(set(first)) == 2
    assert any(p[0].startswith("t1/l1/") for p in first) and all(p[0].endswith("_x.pdf") for p in first)
    twice = spark.createDataFrame([("t1", None, "x.pdf", 1), ("t1", None, "x.pdf", 2)], "tender_id string, lot_id string, filename string, request int")
    assert R.document_rows(twice, "bucket", "request").select("id").distinct().count() == 2


def test_write_never_overwrites(spark, table, tmp_path):
    R.write_fresh(table, str(tmp_path / "t"))
    with pytest.raises(Exception):
        R.write_fresh(table, str(tmp_path / "t"))


def test_filter_documents(spark):
    df = spark.createDataFrame(
        [(1, "t1", True, ["deadline"], {"category": "tech"}, 5), (2, "t2", False, [], {"category": "law"}, 80), (3, "t3", True, None, None, 9)],
        "id int, tender_id string, has_requirements boolean, entity_types array<string>, metadata map<string,string>, page_number int")
    spec = {"$and": [{"tender_id": {"$in": ["t1", "t2"]}}, {"has_requirements": True}, {"page_number": {"$lte": 50}}]}
    assert [r.id for r in df.filter(matches(spec)).collect()] == [1]
    assert [r.id for r in df.filter(matches({"metadata.category": "tech"})).collect()] == [1]
    assert [r.id for r in df.filter(matches({"entity_types": {"$contains": "deadline"}})).collect()] == [1]
    assert df.filter(matches({"page_number": {"$gte": 9}})).count() == 2
    assert df.filter(matches({})).count() == 3
    with pytest.raises(ValueError):
        matches({"id": {"$near": 1}})
    assert df.filter(optional_equals(tender_id="", page_number=0)).count() == 3


def test_value_checks(spark):
    df = spark.createDataFrame([("1234567890", "open", "bando", "a.PDF", 10), ("123", "nope", "x", "a.txt", 10), (None, None, None, "a.docx", 0)],
                               "cig string, status string, kind string, file string, n long")
    got = df.select(V.is_cig("cig"), V.is_tender_status("status"), V.is_document_type("kind"), V.upload_error("file", "n")).collect()
    assert [tuple(r) for r in got] == [
        (True, True, True, None), (False, False, False, "Unsupported file type: .txt"), (False, True, True, "Uploaded file is empty")]
    uuids = spark.createDataFrame([("123e4567-e89b-12d3-a456-426614174000",), ("x",)], "u string").select(V.is_uuid("u")).collect()
    assert [r[0] for r in uuids] == [True, False]


def test_text_helpers(spark):
    df = spark.createDataFrame([("Requisiti tecnici", "Quando scade?"), ("La SCADENZA", "requisiti e data"), ("Altro", "prezzo obbligatorio")],
                               "title string, q string")
    assert [tuple(r) for r in df.select(X.section_type("title"), X.route("q")).collect()] == [
        ("requirements", "graph_only"), ("deadlines", "graph_only"), ("other", "graph_first")]
    text = "Lotto 2: requisito obbligatorio, base d'asta € 100.000 entro il 12/05/2025. Comune di Roma"
    found = spark.createDataFrame([(text,)], "t string").select(X.entities("t").alias("e")).first().e
    assert found.lots == ["Lotto 2"] and found.amounts == ["€ 100.000"] and found.organisations == ["Comune di Roma"]
    assert found.requirements == ["obbligatorio"] and found.deadlines == ["entro il 12/05/2025"]
    shown = spark.createDataFrame([(1234567.0, 0.12345)], "a double, b double").select(X.euros("a"), X.percent(F.col("b"))).first()
    assert tuple(shown) == ("€1,234,567", "12.35%")
    cleaned = spark.createDataFrame([("a\r\nb  c\u0007﻿ ",)], "t string").select(X.clean("t")).first()[0]
    assert cleaned == "a\nb c"


def test_bid_decisions(spark):
    names = list(W.BID_WEIGHTS)
    cases = [("go", [90.0] * 6), ("weak", [45.0] + [90.0] * 5), ("low", [60.0] + [10.0] * 5), ("mid", [75.0] * 6)]
    df = spark.createDataFrame([(n, *v) for n, v in cases], "code string, " + ", ".join(f"{n} double" for n in names))
    assert rows(W.bid_score(df).select("code", "recommendation")) == [
        ("go", "GO"), ("low", "NO-GO"), ("mid", "EVALUATE"), ("weak", "NO-GO")]


def test_bid_score_decides_on_the_score_it_gives(spark):
    # six lots of sizes 4, 7, 7, 11, 24 and 41: the weighted sum is 70, in floating point 70.00000000000001
    df = spark.createDataFrame([("a", 100.0 * (5 / 6), 60.0, 100.0 - 94 / 6, 82.0, 50.0, 20.0)],
                               "code string, " + ", ".join(f"{name} double" for name in W.BID_WEIGHTS))
    assert rows(W.bid_score(df).select("overall_score", "recommendation")) == [(70.0, "EVALUATE")]


def test_checklist(spark):
    needed = spark.createDataFrame([("t", "r1", "a"), ("t", "r2", "b"), ("t", "r3", "c")], "tender_code string, requirement_id string, description string")
    profile = spark.createDataFrame([("r1", True), ("r2", False)], "requirement_id string, covered boolean")
    evidence = spark.createDataFrame([("r1", "k2"), ("r1", "k1")], "requirement_id string, chunk_id string")
    items = W.checklist(needed, profile, evidence)
    assert rows(items.select("requirement_id", "status", "n_evidence")) == [("r1", "compliant", 2), ("r2", "non_compliant", 0), ("r3", "unclear", 0)]
    total = W.checklist_summary(items).first()
    assert (total.total_requirements, total.compliant, total.recommendation) == (3, 1, "NO-GO")


def test_changes_budget_and_lifecycle(spark):
    old = spark.createDataFrame([("a", 1, None), ("b", 2, "x"), ("c", 3, "y")], "k string, v int, w string")
    new = spark.createDataFrame([("a", 1, None), ("b", 2, None), ("d", 4, "z")], "k string, v int, w string")
    assert rows(W.change_set(old, new, "k", ["v", "w"]).select("k", "change")) == [("b", "modified"), ("c", "removed"), ("d", "added")]
    both = old.selectExpr("*", "1 as edition").unionByName(new.selectExpr("*", "2 as edition")).unionByName(new.selectExpr("'z' as k", "v", "w", "3 as edition"))
    assert rows(W.change_set_in_one(both, "k", "edition", 1, 2, ["v", "w"])) == rows(W.change_set(old, new, "k", ["v", "w"]))
    tenders = spark.createDataFrame([("a", 10.0), ("b", 10.0)], "code string, base_amount double")
    totals = spark.createDataFrame([("a", 1, 10.0), ("b", 2, 10.5)], "tender_code string, lot_count long, total_lots_amount double")
    assert [(r.code, r.excess) for r in W.budget_check(tenders, totals).collect()] == [("b", 0.5)]
    today = F.to_date(F.lit("2025-01-01"))
    cases = spark.createDataFrame([("draft", "d", dt.date(2025, 2, 1)), ("open", "d", None), ("draft", "", dt.date(2025, 2, 1)), ("draft", "d", dt.date(2024, 1, 1))],
                                  "s string, d string, x date")
    assert [r[0] for r in cases.select(W.publish_error(F.col("s"), F.col("d"), F.col("x"), today)).collect()] == [
        None, "Cannot publish tender with status: open", "Missing required fields for publication", "Deadline must be in the future"]
    state = spark.createDataFrame([("a", "published"), ("b", "closed"), ("c", "closed")], "code string, status string")
    lots = spark.createDataFrame([("a", "x"), ("b", "x")], "tender_code string, status string")
    kept, new_lots = W.archive(state, lots, state.filter("code <> 'c'"))
    assert rows(kept) == [("a", "published"), ("b", "archived"), ("c", "closed")] and rows(new_lots) == [("a", "x"), ("b", "archived")]


def test_two_patches_of_one_key_fail(spark):
    table = spark.createDataFrame([("a", 1)], "id string, x int")
    patches = spark.createDataFrame([("a", ["x"], 2), ("a", ["x"], 3)], "id string, set_fields array<string>, x int")
    with pytest.raises(Exception, match="more than one patch of key a"):
        R.partial_update(table, patches).collect()
