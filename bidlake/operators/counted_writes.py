"""Graph writes that count what they do: nodes and relationships created and deleted, properties set.

The counters are metrics observed on the rows of the write itself, so that nothing is read or computed
a second time. They can be read once the write has run.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

COUNTERS = ("nodes_created", "nodes_deleted", "relationships_created", "relationships_deleted", "properties_set")
Sink = Callable[[DataFrame, str], None]


@dataclass
class Change:
    """What a write does to one stored table.

    ``before`` holds the stored rows, unique by ``key``. Rows of ``merge`` (unique by key) are created, or
    set the properties they carry on the stored row; a null property is not set. ``delete`` lists keys, and
    ``detach`` (column of ``before``, keys) deletes rows that point at deleted nodes.
    """

    before: DataFrame
    key: str
    merge: DataFrame | None = None
    delete: DataFrame | None = None
    detach: tuple[str, DataFrame] | None = None
    relationship: bool = False
    observed: Observation | None = field(default=None, init=False)

    def rows(self) -> DataFrame:
        """The rows to store, with the counters of this change attached."""
        key = F.col("_key")
        stored = self.before.select(F.col(self.key).alias("_key"), F.struct(*self.before.columns).alias("_old"))
        if self.merge is None:
            joined = stored.withColumn("_new", F.lit(None).cast(stored.schema["_old"].dataType))
            given: list[str] = []
        else:
            given = [c for c in self.merge.columns if c in self.before.columns]
            unknown = [c for c in self.merge.columns if c not in given]
            if unknown:
                raise ValueError(f"not a property of the stored rows: {', '.join(unknown)}")
            joined = stored.join(self.merge.select(F.col(self.key).alias("_key"), F.struct(*given).alias("_new")), "_key", "full_outer")
        gone: Column = F.lit(False)
        if self.delete is not None:
            keys = self.delete.select(F.col(self.key).alias("_key"), F.lit(True).alias("_deleted")).distinct()
            joined = joined.join(keys, "_key", "left")
            gone = F.coalesce("_deleted", F.lit(False))
        if self.detach is not None:
            column, keys = self.detach
            keys = keys.select(F.col(keys.columns[0]).alias("_end"), F.lit(True).alias("_detached")).distinct()
            joined = joined.withColumn("_at", F.coalesce(*([F.col(f"_new.{column}")] if column in given else []), F.col(f"_old.{column}")))
            joined = joined.join(keys, F.col("_at") == F.col("_end"), "left")
            gone = gone | F.coalesce("_detached", F.lit(False))
        had, has = F.col("_old").isNotNull(), F.col("_new").isNotNull()
        values = [F.col(f"_new.{c}").isNotNull().cast("long") for c in given if c != self.key]
        given_values = reduce(lambda a, b: a + b, values, F.lit(0).cast("long"))
        name = "relationships" if self.relationship else "nodes"
        self.observed = Observation()
        counted = joined.observe(
            self.observed, F.count_if(~had & has).alias(f"{name}_created"), F.count_if(had & gone).alias(f"{name}_deleted"),
            # a created row also sets its key
            F.coalesce(F.sum(F.when(has, given_values + (~had).cast("long"))), F.lit(0)).alias("properties_set"))
        kept = counted.filter(~gone)
        return kept.select(*[
            (F.coalesce(F.col(f"_new.{c}"), F.col(f"_old.{c}")) if c in given else F.col(f"_old.{c}")).alias(c) for c in self.before.columns])


def write_counted(changes: Mapping[str, Change], sink: Sink) -> dict[str, int]:
    """Write every changed table by ``sink`` (rows, table name) and return the counters of all of them.

    Each table is read, joined and written once. A null key matches nothing and stays; keys that are
    deleted but not stored count nothing; a row that is both created and deleted is created, then
    left out, and counts as created only.
    """
    totals = dict.fromkeys(COUNTERS, 0)
    for name, change in changes.items():
        sink(change.rows(), name)
        for counter, value in change.observed.get.items():
            totals[counter] += value
    return totals
