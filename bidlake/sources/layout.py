"""Table layouts that stand in for database indexes and co-located storage."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from bidlake.schemas import LOOKUP_COLUMNS, UNIQUE_KEYS


def save_bucketed(df: DataFrame, table: str, key: str, buckets: int) -> None:
    """Store a table hashed and sorted by a join key: joins and groupings on the key between
    tables with the same number of buckets need no shuffle. Meant for keys without hot values,
    since all rows of a key share a bucket."""
    spread = df.repartition(buckets, key)
    spread.write.mode("errorifexists").format("parquet").bucketBy(buckets, key).sortBy(key).saveAsTable(table)


def write_sorted(df: DataFrame, path: str, *columns: str, salt: str | None = None) -> None:
    """Range-partition and sort by lookup columns, so that file and row-group statistics skip
    everything outside a looked-up value or prefix.

    ``salt`` names a unique column that ends the range key: rows sharing one value of the lookup
    columns then span several partitions instead of one.
    """
    keys = [*columns, *([salt] if salt else [])]
    df.repartitionByRange(*keys).sortWithinPartitions(*keys).write.mode("errorifexists").parquet(path)


def write_vertices(df: DataFrame, label: str, path: str) -> None:
    """Store the vertices of a label in the order of its lookup columns."""
    key = UNIQUE_KEYS[label]
    columns = [c for c in LOOKUP_COLUMNS.get(label, ()) if c in df.columns] or [key]
    write_sorted(df, path, *columns, salt=None if key in columns else key)


def key_is_unique(df: DataFrame, label: str) -> bool:
    """Whether the uniqueness rule of a label holds."""
    key = UNIQUE_KEYS[label]
    return df.filter(F.col(key).isNotNull()).groupBy(key).count().filter("count > 1").isEmpty()
