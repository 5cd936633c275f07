"""Stored layouts: co-located joins, data skipping, uniqueness, free-form SQL."""

import pytest
from pyspark.sql import functions as F

from bidlake.plans import graph_sql
from bidlake.sources import layout


def test_bucketed_join_needs_no_shuffle(spark):
    left = spark.range(200).select(F.col("id").cast("string").alias("code"), F.col("id").alias("x"))
    layout.save_bucketed(left, "b_left", "code", 4)
    layout.save_bucketed(left.withColumnRenamed("x", "y"), "b_right", "code", 4)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = spark.table("b_left").join(spark.table("b_right"), "code")
        assert joined.count() == 200
        assert "Exchange hashpartitioning" not in joined._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("drop table b_left")
        spark.sql("drop table b_right")


def test_sorted_vertices_split_a_hot_value(spark, tmp_path):
    rows = spark.range(4000).select(
        F.col("id").cast("string").alias("code"),
        F.when(F.col("id") % 3 == 0, "72000000").otherwise(F.lpad((F.col("id") % 90).cast("string"), 8, "0")).alias("cpv_code"),
        F.lit("b").alias("buyer_name"), F.lit(None).cast("date").alias("publication_date"))
    path = str(tmp_path / "tender")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        layout.write_vertices(rows, "Tender", path)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stored = spark.read.parquet(path)
    assert stored.count() == 4000
    assert stored.filter("cpv_code = '72000000'").select(F.input_file_name()).distinct().count() > 1
    plan = stored.filter(F.col("cpv_code").startswith("72"))._jdf.queryExecution().toString()
    assert "StringStartsWith(cpv_code,72)" in plan


def test_unique_rule_and_fresh_path(spark, tmp_path):
    lots = spark.createDataFrame([("a", "1"), ("a", "2"), (None, "3"), (None, "4")], "id string, cpv_code string")
    assert not layout.key_is_unique(lots, "Lot") and layout.key_is_unique(lots.filter("cpv_code <> '2'"), "Lot")
    layout.write_vertices(lots, "Lot", str(tmp_path / "lot"))
    with pytest.raises(Exception):
        layout.write_vertices(lots, "Lot", str(tmp_path / "lot"))


def test_bound_parameters(spark):
    graph_sql.register({"tender": spark.createDataFrame([("a", 1.0), ("b'", 5.0)], "code string, base_amount double")})
    got = graph_sql.run(spark, "select code from tender where base_amount > :low and code = :code", {"low": 2.0, "code": "b'"})
    assert [r.code for r in got.collect()] == ["b'"]
    assert graph_sql.run(spark, "select count(*) as n from tender").first().n == 2
