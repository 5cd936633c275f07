"""Free-form graph questions as parameterised Spark SQL over registered vertex and edge views."""

from __future__ import annotations

from collections.abc import Mapping
from typing import Any

from pyspark.sql import DataFrame, SparkSession


def register(views: Mapping[str, DataFrame]) -> None:
    for name, df in views.items():
        df.createOrReplaceTempView(name)


def run(spark: SparkSession, text: str, parameters: Mapping[str, Any] | None = None) -> DataFrame:
    """Run a statement with named parameters (``:name``); values are bound, never pasted in."""
    return spark.sql(text, args=dict(parameters or {}))
