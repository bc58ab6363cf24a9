"""What to build: one small dataclass per way of maintaining a table.

The names of parameters and their defaults are fixed values of the public interface.

``source`` is Spark SQL text (with optional named ``params``) or a DataFrame.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import DataFrame, SparkSession

Hook = str | Callable[[SparkSession], Any]


@dataclass(kw_only=True)
class TableConfig:
    target_table: str
    source: str | DataFrame
    params: Mapping[str, Any] | None = None


@dataclass(kw_only=True)
class FullRefresh(TableConfig):
    """Rebuild the table; hooks run before and after."""

    pre_hook: Hook | None = None
    post_hook: Hook | None = None


@dataclass(kw_only=True)
class Incremental(TableConfig):
    """Bring new and changed rows into the table.

    ``incremental_strategy``: merge, delete+insert or insert_overwrite; without a usable key
    rows are appended. ``incremental_column`` is the high-water mark;
    ``overwrite_column`` names the partition value for insert_overwrite (by default the
    incremental column, whose own mark then admits only newer partitions).
    """

    unique_key: str | Sequence[str] = ""
    incremental_column: str = ""
    incremental_strategy: str = "merge"
    on_schema_change: str = "append_new_columns"
    overwrite_column: str = ""
    dedupe_order_by: str | Sequence[str] = ""
    newest_wins: bool = False  # a row older than the target's, by dedupe_order_by, changes nothing
    buckets: int = 0  # lay a new keyed table out in so many buckets of its key; runs rewrite only those they touch


@dataclass(kw_only=True)
class Partitioned(TableConfig):
    """A physically partitioned table: by date granularity, range bounds or value list."""

    partition_by: str
    unique_key: str | Sequence[str] = ""
    partition_type: str = "date"
    partition_granularity: str = "day"
    partition_range: Sequence | None = None
    cluster_by: Sequence[str] = field(default_factory=tuple)
    incremental_column: str = ""
    partition_expiration_days: int | None = None
    dedupe_order_by: str | Sequence[str] = ""
    newest_wins: bool = False  # a row older than the target's, by dedupe_order_by, changes nothing


@dataclass(kw_only=True)
class Scd1(TableConfig):
    """Overwrite changed rows in place and stamp them."""

    unique_key: str | Sequence[str]
    tracked_columns: Sequence[str] = field(default_factory=tuple)
    updated_at_column: str = "updated_at"
    dedupe_order_by: str | Sequence[str] = ""
    newest_wins: bool = False  # a row older than the target's, by dedupe_order_by, changes nothing
    buckets: int = 0  # as for Incremental


@dataclass(kw_only=True)
class Scd2(TableConfig):
    """Keep every version of a row. No tracked columns means all non-key columns."""

    unique_key: str | Sequence[str]
    tracked_columns: Sequence[str] = field(default_factory=tuple)
    valid_from_column: str = "valid_from"
    valid_to_column: str = "valid_to"
    is_current_column: str = "is_current"
    hash_column: str = "row_hash"
    invalidate_hard_deletes: bool = True
    dedupe_order_by: str | Sequence[str] = ""


@dataclass(kw_only=True)
class Snapshot(TableConfig):
    """Append a stamped full copy, keeping the newest ``retain_snapshots``."""

    snapshot_timestamp_column: str = "snapshot_at"
    snapshot_id_column: str = "snapshot_id"
    unique_key: str | Sequence[str] = ""
    dedupe_order_by: str | Sequence[str] = ""
    retain_snapshots: int | None = None


@dataclass(kw_only=True)
class AppendOnly(TableConfig):
    """Insert only."""


@dataclass(kw_only=True)
class View(TableConfig):
    """Create or replace a view over SQL text."""
