"""Registered queries: every entry runs on a folder of parquet tables and, where SQL can say the
same, carries an equivalent statement for an independent engine."""

from __future__ import annotations

from bidlake.plans.catalogue import aggregates, commands, documents, filters, joins, retrieval, sources, workflows
from bidlake.plans.catalogue.registry import REGISTRY

__all__ = [
    "REGISTRY", "aggregates", "commands", "documents", "filters", "joins", "retrieval", "sources", "workflows",
]
