"""Collections as Spark catalog tables: create, describe, read, drop, copy schema."""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from bidlake.schemas import CHUNK_COLLECTION, COLLECTION_TYPES

DEFAULT_SHARDS = 2
# Metric and index settings kept with a collection.
DEFAULT_INDEX = {"field_name": "embedding", "index_type": "HNSW", "metric_type": "IP", "M": 24, "efConstruction": 200}
METADATA_KEYS = ("dim", "max_length", "is_primary")


def build_schema(fields: Sequence[Mapping[str, Any]], strict: bool = False) -> T.StructType:
    """Schema of ``[{name, dtype, dim?, max_length?, is_primary?}, …]``; fields without a name are
    skipped. ``strict`` applies the rules of the collection form."""
    named = [f for f in fields if f.get("name")]
    if strict:
        _check(named)
    return T.StructType([
        T.StructField(
            f["name"], COLLECTION_TYPES[str(f["dtype"]).upper()], not f.get("is_primary", False),
            {"dtype": str(f["dtype"]).upper(), **{k: f[k] for k in METADATA_KEYS if k in f}})
        for f in named])


def _check(fields: Sequence[Mapping[str, Any]]) -> None:
    for f in fields:
        dtype = str(f.get("dtype", "")).upper()
        if dtype not in COLLECTION_TYPES:
            raise ValueError(f"field {f['name']}: unknown type {dtype or '(none)'}")
        if dtype.endswith("FLOAT_VECTOR") and dtype != "SPARSE_FLOAT_VECTOR" and not f.get("dim"):
            raise ValueError(f"field {f['name']}: a vector needs dim")
        if dtype == "VARCHAR" and not f.get("max_length"):
            raise ValueError(f"field {f['name']}: VARCHAR needs max_length")
    if not any(str(f.get("dtype", "")).upper().endswith("VECTOR") for f in fields):
        raise ValueError("a collection needs a vector field")
    if not any(f.get("is_primary") for f in fields):
        raise ValueError("a collection needs a primary key")


def ensure_collection(
    spark: SparkSession, name: str, schema: T.StructType = CHUNK_COLLECTION, shards: int = DEFAULT_SHARDS,
    index: Mapping[str, Any] | None = None,
) -> bool:
    """Create the collection unless it exists; True when created. Shards become hash buckets on
    the first field; index settings are kept as table properties."""
    if spark.catalog.tableExists(name):
        return False
    key = schema.fields[0].name
    writer = spark.createDataFrame([], schema).write.format("parquet").bucketBy(max(shards, 1), key)
    writer.saveAsTable(name)
    properties = {"shards": str(shards), **{f"index.{k}": str(v) for k, v in (index or DEFAULT_INDEX).items()}}
    pairs = ", ".join(f"{_text(k)} = {_text(v)}" for k, v in properties.items())
    spark.sql(f"ALTER TABLE IDENTIFIER(:name) SET TBLPROPERTIES ({pairs})", {"name": name})
    return True


def drop_collection(spark: SparkSession, name: str) -> None:
    spark.sql("DROP TABLE IF EXISTS IDENTIFIER(:name)", {"name": name})


def _text(value: str) -> str:
    """A SQL string literal; properties take no parameter markers."""
    escaped = value.replace("\\", "\\\\").replace("'", "\\'")
    return f"'{escaped}'"


def list_collections(tables: Mapping[str, DataFrame]) -> DataFrame:
    """(name, row_count) per collection."""
    parts = [df.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("name"), "row_count")
             for name, df in tables.items()]
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def catalog_collections(spark: SparkSession) -> dict[str, DataFrame]:
    return {t.name: spark.table(t.name) for t in spark.catalog.listTables() if not t.isTemporary}


def describe(df: DataFrame) -> DataFrame:
    """(name, type, nullable) per column."""
    rows = [(f.name, f.dataType.simpleString(), f.nullable) for f in df.schema.fields]
    return df.sparkSession.createDataFrame(rows, "name string, type string, nullable boolean")


def collection_rows(df: DataFrame, key: str, fields: str | None = None, limit: int = 100) -> DataFrame:
    """First rows by key with comma-separated output fields; limit 1 to 500."""
    if not 1 <= limit <= 500:
        raise ValueError("limit must be between 1 and 500")
    chosen = [f.strip() for f in fields.split(",")] if fields else df.columns
    return df.orderBy(key).limit(limit).select(*chosen)


def preview_rows(df: DataFrame, key: str, limit: int = 20, vector_items: int = 5) -> DataFrame:
    """First rows by key; vectors are shown by their first elements; limit 1 to 200."""
    if not 1 <= limit <= 200:
        raise ValueError("limit must be between 1 and 200")
    shown = [
        F.slice(f.name, 1, vector_items).alias(f.name)
        if isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, (T.FloatType, T.DoubleType))
        else F.col(f.name) for f in df.schema.fields]
    return df.orderBy(key).limit(limit).select(*shown)


def serialised(df: DataFrame) -> DataFrame:
    """Every nested or binary column as text, so a row can be sent as plain JSON."""
    columns = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.StructType, T.ArrayType, T.MapType)):
            columns.append(F.to_json(f.name).alias(f.name))
        elif isinstance(f.dataType, (T.BinaryType, T.DateType, T.TimestampType, T.TimestampNTZType)):
            columns.append(F.col(f.name).cast("string").alias(f.name))
        else:
            columns.append(F.col(f.name))
    return df.select(*columns)


def export_schema(df: DataFrame) -> str:
    return json.dumps(json.loads(df.schema.json()), indent=2)


def import_schema(text: str) -> T.StructType:
    return T.StructType.fromJson(json.loads(text))
