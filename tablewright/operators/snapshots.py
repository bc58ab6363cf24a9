"""Retained point-in-time copies, their pruning, and expiry by age."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import date, datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column, key_list, moment
from .merge import latest_per_key
from .schema import conform


def snapshot_rows(
    source: DataFrame,
    run_ts: datetime | str,
    snapshot_id: str,
    *,
    timestamp_column: str = "snapshot_at",
    id_column: str = "snapshot_id",
    keys: str | Sequence[str] | None = None,
    dedupe_order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """The source stamped as one snapshot, one row per key if keys are given."""
    if key_list(keys):
        if not dedupe_order_by:
            raise ValueError("deduplicating a snapshot needs dedupe_order_by to be deterministic")
        source = latest_per_key(source, keys, dedupe_order_by)
    return source.withColumns({timestamp_column: moment(run_ts), id_column: F.lit(snapshot_id)})


def take_snapshot(
    target: DataFrame,
    source: DataFrame,
    run_ts: datetime | str,
    snapshot_id: str,
    *,
    timestamp_column: str = "snapshot_at",
    id_column: str = "snapshot_id",
    retain: int | None = None,
    keys: str | Sequence[str] | None = None,
    dedupe_order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """Append a snapshot, then keep only the ``retain`` newest ones if asked to."""
    stamped = snapshot_rows(
        source,
        run_ts,
        snapshot_id,
        timestamp_column=timestamp_column,
        id_column=id_column,
        keys=keys,
        dedupe_order_by=dedupe_order_by,
    )
    combined = target.unionByName(conform(stamped, target))
    return prune_snapshots(combined, timestamp_column, retain) if retain else combined


def oldest_kept(df: DataFrame, timestamp_column: str, retain: int) -> DataFrame:
    """One row: the oldest of the ``retain`` newest distinct timestamps.

    The distinct list is as short as the number of snapshots, and the sort with limit is a
    top-k, so no task sees more than that.
    """
    stamp = column(timestamp_column)
    newest = df.filter(stamp.isNotNull()).select(stamp.alias("kept")).distinct()
    return newest.orderBy(F.col("kept").desc()).limit(retain).agg(F.min("kept").alias("oldest"))


def prune_snapshots(df: DataFrame, timestamp_column: str, retain: int) -> DataFrame:
    """Drop rows older than the ``retain`` newest snapshots; rows without a stamp stay."""
    if retain < 1:
        raise ValueError("retain at least one snapshot")
    oldest = oldest_kept(df, timestamp_column, retain).scalar()
    stamp = column(timestamp_column)
    return df.filter(stamp.isNull() | (stamp >= oldest))


def expiry_cutoff(days: int, run_date: date | datetime | str) -> Column:
    return F.date_sub(moment(run_date).cast("date"), days)


def expire_rows(df: DataFrame, date_column: str, days: int, run_date: date | datetime | str) -> DataFrame:
    """Drop rows dated before ``run_date - days``; rows without a date stay."""
    when = column(date_column)
    return df.filter(when.isNull() | (when >= expiry_cutoff(days, run_date)))
