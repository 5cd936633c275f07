"""Queries and commands on the relational tables. A command returns the resulting table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from bidlake.functions.filters import optional_equals
from bidlake.functions.text import stable_id

PAGE_LIMIT = 100


def point_lookup(df: DataFrame, key: str, value: object) -> DataFrame:
    return df.filter(F.col(key) == F.lit(value))


def page(df: DataFrame, *order: str, limit: int = PAGE_LIMIT, offset: int = 0, **conditions: object) -> DataFrame:
    """One page in a total order, with optional equality filters."""
    return df.filter(optional_equals(**conditions)).orderBy(*order).offset(offset).limit(limit)


def page_with_total(df: DataFrame, *order: str, limit: int = PAGE_LIMIT, offset: int = 0,
                    **conditions: object) -> DataFrame:
    """A page whose rows carry the total number of matching rows."""
    matching = df.filter(optional_equals(**conditions))
    total = matching.agg(F.count(F.lit(1)).alias("n")).scalar()
    return matching.orderBy(*order).offset(offset).limit(limit).withColumn("total", total)


def search_tenders(
    tenders: DataFrame, text: str | None = None, status: str | None = None, min_budget: float | None = None,
    max_budget: float | None = None, limit: int = PAGE_LIMIT, offset: int = 0,
    text_columns: tuple[str, ...] = ("title", "description", "code"), budget_column: str = "base_amount",
) -> DataFrame:
    """Case-insensitive OR search over text columns with optional filters; a budget of 0 is no bound."""
    result = tenders.filter(optional_equals(status=status))
    if text:
        found = F.lit(False)
        for c in text_columns:
            found = found | F.coalesce(F.col(c).ilike(f"%{text}%"), F.lit(False))
        result = result.filter(found)
    if min_budget:
        result = result.filter(F.col(budget_column) >= min_budget)
    if max_budget:
        result = result.filter(F.col(budget_column) <= max_budget)
    return result.orderBy("code").offset(offset).limit(limit)


def insert(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows, allowMissingColumns=True)


def document_rows(rows: DataFrame, bucket: str, upload_key: str | None = None) -> DataFrame:
    """New documents with their id and storage path ``tender[/lot]/<id>_<filename>``.

    ``upload_key`` names a column that tells uploads of one file name apart (a content hash or a
    request number); without it a file name is one document of its tender and lot.
    """
    ident = stable_id("tender_id", F.coalesce("lot_id", F.lit("")), "filename",
                      *([F.col(upload_key).cast("string")] if upload_key else []))
    unique_name = F.concat(ident, F.lit("_"), F.col("filename"))
    return rows.select(
        ident.alias("id"), *rows.columns,
        F.lit(bucket).alias("storage_bucket"),
        F.concat_ws("/", "tender_id", "lot_id", unique_name).alias("storage_path"))


def delete(table: DataFrame, keys: DataFrame, key: str = "id") -> DataFrame:
    return table.join(keys.select(key).distinct(), key, "left_anti")


def delete_tenders(tenders: DataFrame, lots: DataFrame, documents: DataFrame, keys: DataFrame,
                   ) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Delete tenders with their lots and documents (cascade)."""
    gone = keys.select(F.col("id").alias("tender_id")).distinct()
    return (delete(tenders, keys), lots.join(gone, "tender_id", "left_anti"),
            documents.join(gone, "tender_id", "left_anti"))


def delete_lots(lots: DataFrame, documents: DataFrame, keys: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delete lots; their documents stay and lose the reference."""
    gone = keys.select(F.col("id").alias("_gone")).distinct()
    documents = documents.join(gone, F.col("lot_id") == F.col("_gone"), "left")
    documents = documents.withColumn("lot_id", F.when(F.col("_gone").isNull(), F.col("lot_id"))).drop("_gone")
    return delete(lots, keys), documents


def partial_update(table: DataFrame, patches: DataFrame, key: str = "id") -> DataFrame:
    """Apply patches carrying ``set_fields``: a listed field takes the patch value, null included;
    any other keeps its own. Patches of unknown keys do nothing; two patches of one key fail the job
    (order them with ``last_per_key`` first)."""
    values = [c for c in patches.columns if c not in (key, "set_fields")]
    grouped = patches.groupBy(key).agg(F.first(F.struct("set_fields", *values)).alias("_patch"), F.count(F.lit(1)).alias("_n"))
    repeated = F.raise_error(F.concat(F.lit("more than one patch of key "), F.col(key).cast("string")))
    patch = grouped.select(key, F.when(F.col("_n") == 1, F.col("_patch")).otherwise(
        repeated.cast(grouped.schema["_patch"].dataType)).alias("_patch"))
    joined = table.join(patch, key, "left")
    columns = []
    for c in table.columns:
        if c in values:
            listed = F.coalesce(F.array_contains("_patch.set_fields", c), F.lit(False))
            columns.append(F.when(listed, F.col(f"_patch.{c}")).otherwise(F.col(c)).alias(c))
        else:
            columns.append(F.col(c))
    return joined.select(*columns)


def last_per_key(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The last row of each key; superseded copies are dropped before the shuffle."""
    newest = Window.partitionBy(key).orderBy(F.desc(order))
    return rows.withColumn("_n", F.row_number().over(newest)).filter("_n = 1").drop("_n")


def upsert(table: DataFrame, rows: DataFrame, key: str, order: str) -> DataFrame:
    """Insert or replace by key; within ``rows`` the largest ``order`` wins. Untouched rows of
    ``table`` are neither sorted nor ranked, only filtered by an anti join on the new keys."""
    incoming = last_per_key(rows, key, order).select(*table.columns)
    return table.join(rows.select(key).distinct(), key, "left_anti").unionByName(incoming)


def write_fresh(df: DataFrame, path: str, *partition_by: str) -> None:
    """Write to a folder that must not exist yet, so a table is never overwritten while read."""
    df.write.mode("errorifexists").partitionBy(*partition_by).parquet(path)
