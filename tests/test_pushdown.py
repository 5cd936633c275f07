"""Filters on one tender, or on days, reach the scans of the stored tables."""

import pytest

from bidlake.plans.catalogue import REGISTRY
from bidlake.sources import domain
from bidlake.sources.tables import Tables

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(autouse=True)
def whole_plans(spark):
    """Plans are printed without cutting their filters short."""
    spark.conf.set("spark.sql.maxMetadataStringLength", "4000")
    yield
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def scans(df):
    plan = df._jdf.queryExecution().toString()
    return [line for line in plan[plan.index("== Physical Plan =="):].splitlines() if "FileScan parquet" in line]


def pushed(line):
    return line[line.index("PushedFilters: "):line.index("ReadSchema")]


@pytest.mark.parametrize(("name", "column"), [
    ("f1_point", "o_orderkey"), ("f2_tender_by_code", "o_orderkey"), ("f17_timeline", "o_orderdate"), ("j1_one_tender", "o_orderkey"),
    ("j1_one_tender", "l_orderkey"), ("t9_deadlines", "l_orderkey")])
def test_raw_keys_and_days_are_pushed(spark, name, column):
    found = [x for x in scans(REGISTRY[name](spark, FOLDER)) if column in x]
    assert found and all(f"({column}," in pushed(x).replace("IsNotNull", "") for x in found)


@pytest.mark.parametrize("name", ["j3_related_tenders", "j12_same_buyer_cpv"])
def test_the_reference_row_is_one_filtered_read(spark, name):
    orders = [x for x in scans(REGISTRY[name](spark, FOLDER)) if "o_orderkey" in x]
    # the plan text repeats the one subquery at each of its uses
    assert sum("EqualTo(o_orderkey," not in pushed(x) for x in orders) == 1 and len(orders) > 1


def test_codes_that_are_no_number_name_no_tender(spark):
    t = Tables(spark, FOLDER)
    assert domain.tenders(t, ["x", "007", "", "-1", "²"]).count() == 0
    assert domain.tenders(t, []).count() == 0
    assert [r.code for r in domain.tenders(t, ["7", "x"]).collect()] == ["7"]


def test_days_are_both_included(spark):
    t = Tables(spark, FOLDER)
    every = domain.tenders(t)
    day = str(every.selectExpr("min(publication_date) as d").first().d)
    got = domain.tenders(t, published=(day, day)).count()
    assert got == every.filter(f"publication_date = date '{day}'").count() > 0


@pytest.mark.parametrize(("name", "column", "most"), [
    ("a2_label_counts", "text", 1), ("a9_health", "text", 1), ("a9_health", "o_orderkey", 1), ("u3_change_detection", "o_orderkey", 1),
    ("u3_change_detection", "l_orderkey", 1), ("x16_archive", "o_orderkey", 4)])
def test_tables_are_read_once(spark, name, column, most):
    """Of the archive, tenders and lots each meet the keys, and the lots also their tenders."""
    assert 0 < sum(column in x for x in scans(REGISTRY[name](spark, FOLDER))) <= most


def test_common_texts_share_one_shuffle(spark):
    df = REGISTRY["a5_common_texts"](spark, FOLDER)
    df.collect()
    assert "ReusedExchange" in df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", ["j2_chunk_context", "j6_enriched_chunks", "a2_label_counts"])
def test_no_text_is_shuffled_for_its_section(spark, name):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = REGISTRY[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString().splitlines()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    read = [i for i, line in enumerate(lines) if "FileScan parquet" in line and "text#" in line]
    cut = max(i for i in range(read[0]) if "Generate" in lines[i])
    assert len(read) == 1 and not any("Exchange" in line for line in lines[cut:read[0]])


def test_tenders_of_documents_are_picked_before_they_meet_buyers(spark):
    t = Tables(spark, FOLDER)
    only = t.documents.filter("doc_id in (3, 5)").select("doc_id", "text")
    assert sorted(r.code for r in domain.tenders(t, only=only.union(only)).collect()) == ["3", "5"]
    assert sum("o_orderkey" in x for x in scans(REGISTRY["j2_chunk_context"](spark, FOLDER))) == 1


def test_every_chunk_keeps_its_sections(spark, tmp_path):
    """As with documents joined first: a document without a section has 'other', repeated rows count each."""
    spark.createDataFrame([(1, "a b c"), (1, "a"), (2, "x " * 300), (3, ""), (4, None), (None, "n")], "doc_id long, text string").write.parquet(
        str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 0), (1, 4), (2, None), (None, 1), (9, 1)], "vec_id long, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    t = Tables(spark, str(tmp_path))
    t._read["documents"] = spark.read.parquet(f"{tmp_path}/documents.parquet").selectExpr("*", "'en' as lang", "'s' as source")
    same = ["id", "tender_code", "doc_id", "chunk_index", "section_type"]
    links = sorted(map(tuple, domain.chunk_links(t).select(same).collect()), key=str)
    assert links == sorted(map(tuple, domain.chunks(t).select(same).collect()), key=str)
    assert [(r[0], r[4]) for r in links] == [
        ("1-0", "deadlines"), ("1-0", "deadlines"), ("1-0", "requirements"), ("1-0", "requirements"), ("2-0", "other"), ("2-1", "other"), (None, "other")]
