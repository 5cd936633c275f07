"""Counters of graph writes, taken from the write itself."""

import pytest
from pyspark.sql import functions as F

from bidlake.operators.counted_writes import Change, write_counted


@pytest.fixture
def graph(spark):
    nodes = spark.createDataFrame([("a", "A", 1.0), ("b", "B", None), ("c", None, 3.0), (None, "lost", 0.0)], "code string, title string, amount double")
    edges = spark.createDataFrame([("l1", "a"), ("l2", "b"), ("l3", "b"), ("l4", None)], "id string, code string")
    return nodes, edges


def test_counts_and_rows(spark, tmp_path, graph):
    nodes, edges = graph
    merge = spark.createDataFrame([("b", "B2", 5.0), ("c", None, 4.0), ("d", "D", None)], "code string, title string, amount double")
    gone = spark.createDataFrame([("b",), ("zz",), ("b",)], "code string")

    def sink(rows, name):
        rows.write.parquet(str(tmp_path / name))

    totals = write_counted({
        "Tender": Change(nodes, "code", merge, gone),
        "HAS_LOT": Change(edges, "id", spark.createDataFrame([("l5", "d"), ("l1", "c")], "id string, code string"), detach=("code", gone), relationship=True),
    }, sink)
    # b: 2, c: 1, d: key and title; l5: key and end, l1: end
    assert totals == {"nodes_created": 1, "nodes_deleted": 1, "relationships_created": 1, "relationships_deleted": 2, "properties_set": 5 + 3}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "Tender")).collect()} == {
        ("a", "A", 1.0), ("c", None, 4.0), ("d", "D", None), (None, "lost", 0.0)}
    assert {tuple(r) for r in spark.read.parquet(str(tmp_path / "HAS_LOT")).collect()} == {("l1", "c"), ("l4", None), ("l5", "d")}


def test_deletes_alone_and_empty_tables(spark, graph):
    nodes, _ = graph
    none = nodes.limit(0)

    def discard(rows, name):
        rows.write.format("noop").mode("overwrite").save()

    assert write_counted({"n": Change(nodes, "code", delete=nodes.select("code"))}, discard)["nodes_deleted"] == 3
    assert set(write_counted({"n": Change(none, "code", none, none.select("code"))}, discard).values()) == {0}
    assert write_counted({}, discard)["properties_set"] == 0


def test_the_stored_table_is_read_once(spark, tmp_path, graph):
    nodes, _ = graph
    nodes.write.parquet(str(tmp_path / "nodes"))
    merge = spark.createDataFrame([("d", "D")], "code string, title string")
    rows = Change(spark.read.parquet(str(tmp_path / "nodes")), "code", merge).rows()
    plan = rows._jdf.queryExecution().toString()
    physical = plan[plan.index("== Physical Plan =="):]
    assert physical.count("FileScan parquet") == 1 and "CollectMetrics" in physical


def test_unknown_properties_are_refused(spark, graph):
    with pytest.raises(ValueError, match="colour"):
        Change(graph[0], "code", graph[0].withColumn("colour", F.lit("red"))).rows()
