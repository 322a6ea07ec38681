"""Every query module, imported: after this the registry is full."""

from graphloom.plans import catalog_queries, constraint_queries, export_queries, grounding_queries, row_queries, shell_queries, stream_queries, text_queries, validation_queries, workflow_queries  # noqa: F401
from graphloom.plans.registry import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
