"""tablewright: building and maintaining warehouse tables with Spark."""

from .config import AppendOnly, FullRefresh, Incremental, Partitioned, Scd1, Scd2, Snapshot, TableConfig, View
from .plans import materialize

__all__ = [
    "AppendOnly",
    "FullRefresh",
    "Incremental",
    "Partitioned",
    "Scd1",
    "Scd2",
    "Snapshot",
    "TableConfig",
    "View",
    "materialize",
]
