"""Helpers for vector columns."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def usable(column: str):
    """Not null, not empty or all zero, every component present and finite."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(v.isNotNull() & finite & F.exists(v, lambda x: x != 0), F.lit(False))


def matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """Vectors of one width as a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def distinct_vectors(rows: DataFrame, ids_kept: int) -> DataFrame:
    """(vector, width, ids): equal vectors once, with the ``ids_kept`` smallest of their ids.

    ``rows`` has id and vector. Each task cuts a vector's ids before the shuffle.
    """
    order = Window.partitionBy("vector").orderBy("id")
    cut = rows.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= ids_kept)
    return cut.groupBy("vector").agg(F.array_sort(F.collect_list("id")).alias("ids")).withColumn("width", F.size("vector"))
