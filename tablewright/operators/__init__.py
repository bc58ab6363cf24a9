"""Lazy ``DataFrame -> DataFrame`` operators. None of the table transitions runs an action."""

from .checks import CheckFailed, enforce, expect, in_set, min_rows, not_null, unique, freshness
from .dimensions import (
    as_of,
    current_rows,
    key_history,
    scd1,
    scd1_initial,
    scd2,
    scd2_initial,
    scd2_parts,
)
from .lineage import (
    CycleFound,
    cycle_nodes,
    cycle_path,
    downstream_subgraph,
    propagate_failures,
    reachable_nodes,
    reachable_pairs,
    run_status,
    topological_levels,
    topological_order,
)
from .merge import append_rows, delete_insert, latest_per_key, merge, overwrite_by_value, single_row_per_key
from .runlog import (
    explode_steps,
    last_run,
    last_successful_run,
    recent_runs,
    runs_per_key,
    status_summary,
)
from .schema import SchemaChanged, align_schemas, conform, describe
from .snapshots import expire_rows, prune_snapshots, snapshot_rows, take_snapshot
from .watermark import high_watermark, newer_than, newer_than_target

__all__ = [name for name in dir() if not name.startswith("_")]
