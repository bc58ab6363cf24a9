"""Runnable queries over the test tables, each with SQL that states its expected result."""

from . import changes, dimensions, graph, loads, merges, partitions, quality, reports, snapshots, streams, warehouse
from .registry import QUERIES, SQL

__all__ = [
    "QUERIES",
    "SQL",
    "changes",
    "dimensions",
    "graph",
    "loads",
    "merges",
    "partitions",
    "quality",
    "reports",
    "snapshots",
    "streams",
    "warehouse",
]
