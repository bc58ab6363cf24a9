"""``materialize``: bring one table to its next state and report what was done."""

from __future__ import annotations

import uuid
import warnings
from collections.abc import Callable
from datetime import date, datetime, timedelta, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, IntegralType, StringType, TimestampType

from ..config import (
    AppendOnly,
    FullRefresh,
    Hook,
    Incremental,
    Partitioned,
    Scd1,
    Scd2,
    Snapshot,
    TableConfig,
    View,
)
from ..functions.columns import column, equal_keys, field, has_key, key_list, moment
from ..functions.partitioning import date_partition, list_partition, range_partition
from ..operators.dimensions import VersionColumns, scd1, scd1_initial, scd2, scd2_initial, scd2_parts
from ..operators.merge import delete_insert, merge, not_older, one_row_per_key, overwrite_by_value, upsert
from ..operators.schema import SchemaChanged, align_schemas, conform
from ..operators.snapshots import prune_snapshots, snapshot_rows
from ..operators.watermark import high_watermark, newer_than
from ..scratch import discarding_stages, staged
from . import buckets, commit, journal
from .marks import kept_mark, note_rewritten


def source_frame(spark: SparkSession, config: TableConfig) -> DataFrame:
    if isinstance(config.source, DataFrame):
        return config.source
    return spark.sql(config.source, args=dict(config.params) if config.params else None)


def materialize(
    spark: SparkSession,
    config: TableConfig,
    *,
    run_ts: datetime | None = None,
    snapshot_id: str | None = None,
    count_rows: bool = True,
) -> dict:
    """Run ``config`` and return ``strategy``, ``table`` and, but for views, ``rows``.

    ``rows`` is the size of the table afterwards; ``count_rows=False`` leaves it out and saves
    reading the footers of all its files. ``run_ts`` (UTC, by default now) stamps audit columns and dates expiry, so a repeated
    run can be given the time of the first.
    """
    handler = _HANDLERS.get(type(config))
    if handler is None:
        raise ValueError(f"unknown materialization: {type(config).__name__}")
    run = _Run(
        run_ts=run_ts or datetime.now(timezone.utc).replace(tzinfo=None),
        snapshot_id=snapshot_id or uuid.uuid4().hex[:8],
    )
    with discarding_stages(spark):
        if not isinstance(config, View):
            _recover(spark, config)
        strategy, extra = handler(spark, config, run)
    result = {"strategy": strategy, "table": config.target_table, **extra}
    if count_rows and strategy != "view":
        result["rows"] = commit.row_count(spark, config.target_table)
    return result


class _Run:
    def __init__(self, run_ts: datetime, snapshot_id: str):
        self.run_ts = run_ts
        self.snapshot_id = snapshot_id


def _recover(spark: SparkSession, config: TableConfig) -> None:
    """Finish or undo what a run that died between two commits noted."""
    record = journal.pending(spark, config.target_table)
    if record is None:
        return
    if record["kind"] == "rename":
        commit.finish_rename(spark, config.target_table, record["made"])
    elif record["kind"] == "versions" and commit.table_exists(spark, config.target_table):
        _undo_closing(spark, config.target_table, VersionColumns(*record["names"]), record["keys"], record["run_ts"])
    journal.settle(spark, config.target_table)


def _call(spark: SparkSession, hook: Hook | None) -> None:
    if callable(hook):
        hook(spark)
    elif hook:
        spark.sql(hook)


def _target(spark: SparkSession, config: TableConfig) -> DataFrame:
    return spark.table(commit.table_name(config.target_table))


def _create_keyed(
    spark, name: str, source: DataFrame, keys: list[str], order_by, finish, partition_by=(), cluster_by=(), n_buckets=0
) -> None:
    """First load of a keyed table: one row per key, or no table.

    ``finish`` adds what the table has besides. The source is written once; its key columns
    are checked for repeats before anything is published.
    """
    source = staged(source, "source")
    if order_by:
        source = one_row_per_key(source, keys, order_by)
    else:
        _refuse_repeats(source, keys)
    if n_buckets:
        commit.create(buckets.with_bucket(finish(source), keys, n_buckets), name, [buckets.BUCKET], cluster_by)
        buckets.mark(spark, name, n_buckets)
    else:
        commit.create(finish(source), name, partition_by, cluster_by)


def _refuse_new_columns(target: DataFrame, source: DataFrame) -> None:
    """For tables without a schema policy: a column the table lacks is an error, not dropped."""
    new = [c for c in source.columns if c not in target.columns]
    if new:
        raise SchemaChanged(f"columns not in the target: {new}")


def _refuse_repeats(df: DataFrame, keys: list[str]) -> None:
    repeated = df.filter(has_key(keys)).groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).filter("rows > 1")
    example = repeated.first()
    if example is not None:
        raise ValueError(f"duplicate source key: {example.asDict()}")


def _full_refresh(spark, config: FullRefresh, run):
    _call(spark, config.pre_hook)
    df = source_frame(spark, config)
    if not commit.table_exists(spark, config.target_table):
        commit.create(df, config.target_table)
    elif commit.partition_columns(spark, config.target_table):
        commit.replace_table(df, config.target_table)
    else:
        commit.swap(df, config.target_table)
    _call(spark, config.post_hook)
    return "full_refresh", {}


def _incremental(spark, config: Incremental, run):
    keys = key_list(config.unique_key)
    by_value = config.overwrite_column or config.incremental_column
    source = source_frame(spark, config)
    if config.incremental_strategy == "insert_overwrite" and not by_value:
        raise ValueError("insert_overwrite needs overwrite_column or incremental_column")

    if not commit.table_exists(spark, config.target_table):
        partition_by = []
        if config.incremental_strategy == "insert_overwrite" and _partitionable(source, by_value):
            partition_by = [by_value]
        if keys and config.incremental_strategy == "merge":
            _create_keyed(
                spark, config.target_table, source, keys, config.dedupe_order_by, lambda df: df, partition_by, n_buckets=config.buckets
            )
            return "incremental", {"first_run": True}
        if keys and config.dedupe_order_by:
            source = one_row_per_key(staged(source, "source"), keys, config.dedupe_order_by)
        if keys and config.buckets and config.incremental_strategy == "delete+insert":
            commit.create(buckets.with_bucket(source, keys, config.buckets), config.target_table, [buckets.BUCKET])
            buckets.mark(spark, config.target_table, config.buckets)
        else:
            commit.create(source, config.target_table, partition_by)
        return "incremental", {"first_run": True}

    target = _target(spark, config)
    mark = None
    if config.incremental_column:
        mark = kept_mark(spark, config.target_table, config.incremental_column)
        target = _target(spark, config)
        source = newer_than(source, config.incremental_column, mark)

    if config.incremental_strategy == "insert_overwrite":
        _overwrite(spark, config, target, source, by_value)
    elif keys and config.incremental_strategy in ("merge", "delete+insert") and _in_buckets(spark, config, target, source, keys):
        pass
    elif config.incremental_strategy == "merge" and keys and commit.has_row_changes(spark, config.target_table):
        # The table format keeps its own schema rules; on_schema_change is left to it.
        unique = one_row_per_key(staged(source, "source"), keys, config.dedupe_order_by or None)
        commit.merge_into(unique, config.target_table, keys)
    elif config.incremental_strategy == "merge" and keys:
        delivered = staged(source, "source")
        after = merge(
            target,
            delivered,
            keys,
            on_schema_change=config.on_schema_change,
            dedupe_order_by=config.dedupe_order_by or None,
            newest_wins=config.newest_wins,
        )
        commit.rewrite(after, config.target_table)
        if config.incremental_column and not config.dedupe_order_by:  # an order may leave delivered rows out
            note_rewritten(spark, config.target_table, config.incremental_column, mark, delivered)
    elif config.incremental_strategy == "delete+insert" and keys:
        target, source = align_schemas(target, source, config.on_schema_change, keys)
        delivered = staged(source)
        commit.rewrite(delete_insert(target, delivered, keys), config.target_table)
        if config.incremental_column:
            note_rewritten(spark, config.target_table, config.incremental_column, mark, delivered)
    else:
        if config.incremental_strategy not in ("merge", "delete+insert", "append"):
            warnings.warn(f"unknown incremental_strategy {config.incremental_strategy!r}: appending", stacklevel=3)
        commit.append(conform(source, target), config.target_table)
    return "incremental", {"first_run": False}


def _in_buckets(spark, config: Incremental, target: DataFrame, source: DataFrame, keys: list[str]) -> bool:
    """Bring a bucketed table to its next state by its touched buckets; false if that cannot be."""
    if not buckets.buckets_of(spark, config.target_table):
        return False
    if buckets.BUCKET in source.columns:
        raise ValueError(f"the source has a column {buckets.BUCKET} of its own")
    number = F.lit(None).cast("int").alias(buckets.BUCKET)
    after, bucketed = align_schemas(target, source.select("*", number), config.on_schema_change, keys)
    source = bucketed.drop(buckets.BUCKET)
    have = {f.name: f.dataType for f in after.schema.fields}
    if any(have.get(f.name) != f.dataType for f in target.schema.fields):
        raise SchemaChanged("a bucketed table cannot lose or widen columns; rebuild it with a full refresh")
    target = after

    def transition(scope: DataFrame, delivered: DataFrame) -> DataFrame:
        if config.incremental_strategy == "delete+insert":
            return delete_insert(scope, delivered, keys)
        order_by = config.dedupe_order_by or None
        update_if = not_older(order_by, scope) if config.newest_wins else None
        return upsert(scope, delivered, keys, update_if=update_if, dedupe_order_by=order_by)

    buckets.change(config.target_table, target, source, keys, transition)
    return True


def _partitionable(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, (DateType, StringType, IntegralType))


def _overwrite(spark, config, target, source, by_value):
    source = staged(conform(source, target), "source")  # read twice, and it may read the target
    if commit.partition_columns(spark, config.target_table) != [by_value]:
        commit.rewrite(overwrite_by_value(target, source, by_value), config.target_table)
        return
    # The target's other rows are never read. A NULL value matches nothing, so the old NULL
    # rows must survive the replacement of the NULL partition.
    unset = column(by_value).isNull()
    commit.replace_partitions(source.filter(~unset), config.target_table)
    if not source.filter(unset).isEmpty():
        commit.append(source.filter(unset), config.target_table)


def partition_name(config: Partitioned) -> str:
    """The physical partition column: the column itself for whole days, else a derived one."""
    suffix = config.partition_granularity if config.partition_type == "date" else config.partition_type
    return f"{config.partition_by}_{suffix}"


def _with_partition(df: DataFrame, config: Partitioned) -> tuple[DataFrame, str]:
    name, source = partition_name(config), column(config.partition_by)
    if config.partition_type == "date":
        whole_days = isinstance(df.schema[config.partition_by].dataType, DateType)
        if whole_days and config.partition_granularity == "day":
            return df, config.partition_by
        return df.withColumn(name, date_partition(source, config.partition_granularity)), name
    if config.partition_type == "range":
        return df.withColumn(name, range_partition(source, config.partition_range or ())), name
    if config.partition_type == "list":
        return df.withColumn(name, list_partition(source, config.partition_range or ())), name
    raise ValueError(f"partition_type {config.partition_type!r} is not date, range or list")


def _partitioned(spark, config: Partitioned, run):
    source, partition = _with_partition(source_frame(spark, config), config)
    keys = key_list(config.unique_key)
    if not commit.table_exists(spark, config.target_table):
        if keys:
            _create_keyed(spark, config.target_table, source, keys, config.dedupe_order_by, lambda df: df, [partition], config.cluster_by)
        else:
            commit.create(source, config.target_table, [partition], config.cluster_by)
        return "partitioned", {"first_run": True}

    target = _target(spark, config)
    if config.incremental_column:
        source = newer_than(source, config.incremental_column, _partitioned_mark(spark, config, target, partition))
    if keys:
        _merge_touched(spark, config, target, staged(source, "source"), keys, partition)
    else:
        commit.append(conform(source, target), config.target_table, config.cluster_by)
    if config.partition_expiration_days:
        _expire(spark, config, partition, run.run_ts.date())
    return "partitioned", {"first_run": False}


def _merge_touched(spark, config, target, source, keys, partition):
    """Merge by rewriting only partitions the source names or a matched row lies in.

    A matched row may move to another partition; the one it leaves is rewritten too, and
    dropped if nothing is left in it. One join with the target's keys tells all that: which keys
    match, where they lie and which of them leave. The list of touched partitions comes to the
    driver: it is at most as long as the catalog's own.
    """
    align_schemas(target, source, "ignore", keys)  # the keys must be there
    _refuse_new_columns(target, source)
    if config.dedupe_order_by:
        source = staged(one_row_per_key(source, keys, config.dedupe_order_by), "latest")
    update_if = not_older(config.dedupe_order_by, target) if config.newest_wins else None
    zero = F.lit(0).cast("bigint")
    touched, matched_keys = source.select(column(partition).alias("__old"), zero.alias("__left"), F.lit(True).alias("__named")), None
    if config.partition_by not in keys:
        leaves = ~field("t", partition).eqNullSafe(field("s", partition))
        if update_if is not None:
            leaves = leaves & F.coalesce(update_if("t", "s"), F.lit(False))
        met = target.alias("t").join(source.alias("s"), equal_keys("t", "s", keys))
        own_keys = [field("t", k).alias(k) for k in keys]
        matches = staged(met.select(*own_keys, field("t", partition).alias("__old"), leaves.alias("__leaves")), "matches")
        matched_keys = matches.select(*keys).distinct()
        touched = touched.unionByName(matches.select("__old", F.col("__leaves").cast("bigint").alias("__left"), F.lit(False).alias("__named")))
    touched = touched.groupBy("__old").agg(F.sum("__left").alias("left"), F.bool_or("__named").alias("named")).collect()
    if not touched:
        return
    scope = commit.in_partitions(target, partition, [r[0] for r in touched])
    after = upsert(scope, source, keys, update_if=update_if, matched_keys=matched_keys)
    # a row that names a partition fills it, unless it may be turned down as the older one
    left = {r[0]: r.left for r in touched if r.left and not (r.named and update_if is None)}
    before = commit.in_partitions(target, partition, list(left)).groupBy(partition).count().collect() if left else []
    emptied = [r[0] for r in before if r["count"] == left[r[0]]]
    if emptied and update_if is not None:
        filled = {r[0] for r in commit.in_partitions(after, partition, emptied).select(partition).distinct().collect()}
        emptied = [v for v in emptied if v not in filled]
    commit.replace_partitions(after, config.target_table, config.cluster_by)
    commit.drop_partitions(spark, config.target_table, partition, emptied)


def _partitioned_mark(spark, config: Partitioned, target: DataFrame, partition: str):
    """The high-water mark; from the last partition alone where those are dates of the very column.

    TIMESTAMP columns are left out, since their dates depend on the time zone a row was written in.
    """
    name = config.incremental_column
    zoned = isinstance(target.schema[name].dataType, TimestampType)
    if config.partition_type == "date" and config.partition_by == name and not zoned:
        dates = [v for v in commit.partition_values(spark, config.target_table) if v is not None]
        if dates and len({len(v) for v in dates}) == 1:  # the order of such texts is that of time
            mark = high_watermark(commit.in_partitions(target, partition, [max(dates)]), name)
            if mark is not None:
                return mark
    return high_watermark(target, name)


def _expire(spark, config: Partitioned, partition: str, run_date: date) -> None:
    """Drop rows dated before the cutoff: whole partitions through the catalog where dated."""
    cutoff = run_date - timedelta(days=config.partition_expiration_days)
    table = config.target_table
    if config.partition_type == "date":
        start = {"month": cutoff.replace(day=1), "year": cutoff.replace(month=1, day=1)}.get(
            config.partition_granularity, cutoff
        )
        values = [v for v in commit.partition_values(spark, table) if v is not None]
        commit.drop_partitions(spark, table, partition, [v for v in values if v < start.isoformat()])
        if start == cutoff:
            return
        split = [start.isoformat()] if start.isoformat() in values else []
    else:
        dated = _target(spark, config).filter(column(config.partition_by) < moment(cutoff))
        split = [r[0] for r in dated.select(partition).distinct().collect()]  # one row per partition
    if not split:
        return
    rest = commit.in_partitions(_target(spark, config), partition, split)
    rest = rest.filter(~F.coalesce(column(config.partition_by) < moment(cutoff), F.lit(False)))
    left_in = {str(r[0]) for r in rest.select(partition).distinct().collect()}
    commit.replace_partitions(rest, table, config.cluster_by)
    commit.drop_partitions(spark, table, partition, [v for v in split if str(v) not in left_in])


def _scd1(spark, config: Scd1, run):
    keys = key_list(config.unique_key)
    source = source_frame(spark, config)
    if not commit.table_exists(spark, config.target_table):
        finish = lambda df: scd1_initial(df, run.run_ts, config.updated_at_column)
        _create_keyed(spark, config.target_table, source, keys, config.dedupe_order_by, finish, n_buckets=config.buckets)
        return "scd_type_1", {"first_run": True}
    target = _target(spark, config)
    _refuse_new_columns(target, source)

    def transition(scope: DataFrame, delivered: DataFrame) -> DataFrame:
        return scd1(
            scope,
            delivered,
            keys,
            config.tracked_columns,
            run.run_ts,
            updated_at=config.updated_at_column,
            dedupe_order_by=config.dedupe_order_by or None,
            newest_wins=config.newest_wins,
        )

    if buckets.buckets_of(spark, config.target_table):
        buckets.change(config.target_table, target, source, keys, transition)
    else:
        commit.rewrite(transition(target, staged(source, "source")), config.target_table)
    return "scd_type_1", {"first_run": False}


def _scd2(spark, config: Scd2, run):
    """The table is partitioned by its current flag, so a run rewrites only open versions.

    Two commits: newly closed versions are appended to the history, then the current slice
    is replaced. Both are noted beforehand. If a run dies in between, those versions are both
    closed and open; the next run finds the note and takes them out of the history again, so
    that it starts from the state before. Without a note the history is not read.
    """
    names = VersionColumns(
        config.valid_from_column, config.valid_to_column, config.is_current_column, config.hash_column
    )
    keys = key_list(config.unique_key)
    source = source_frame(spark, config)
    if not commit.table_exists(spark, config.target_table):
        finish = lambda df: scd2_initial(df, keys, config.tracked_columns, run.run_ts, names)
        _create_keyed(spark, config.target_table, source, keys, config.dedupe_order_by, finish, [names.is_current])
        return "scd_type_2", {"first_run": True}

    target = _target(spark, config)
    _refuse_new_columns(target, source)
    source = staged(source, "source")
    if not config.dedupe_order_by:
        _refuse_repeats(source, keys)  # before the first of the two commits
    options = {
        "names": names,
        "close_missing": config.invalidate_hard_deletes,
        "dedupe_order_by": config.dedupe_order_by or None,
    }
    if commit.partition_columns(spark, config.target_table) != [names.is_current]:  # not made by this library
        after = scd2(target, source, keys, config.tracked_columns, run.run_ts, **options)
        commit.rewrite(after, config.target_table)
        return "scd_type_2", {"first_run": False}
    parts = scd2_parts(target, source, keys, config.tracked_columns, run.run_ts, **options)
    note = {"names": [names.valid_from, names.valid_to, names.is_current, names.row_hash], "keys": keys, "run_ts": run.run_ts.isoformat(sep=" ")}
    with journal.intent(spark, config.target_table, "versions", **note):
        commit.append(parts.closed, config.target_table)
        if config.invalidate_hard_deletes and source.isEmpty():  # writing no rows would replace no partition
            commit.drop_partitions(spark, config.target_table, names.is_current, ["true"])
        else:
            commit.replace_partitions(parts.current, config.target_table)
    return "scd_type_2", {"first_run": False}


def _undo_closing(spark, name: str, names: VersionColumns, keys: list[str], run_ts: str) -> None:
    """Undo the first of a died run's two commits: drop closed copies of versions still open.

    Such a copy ends at the time of the run, which the scan of the history is filtered by; often there
    is none, and then nothing is written.
    """
    target = spark.table(commit.table_name(name))
    is_open = F.coalesce(column(names.is_current), F.lit(False))
    current, history = target.filter(is_open), target.filter(~is_open)
    same = equal_version("h", "t", [*keys, names.valid_from, names.row_hash])
    ended = column(names.valid_to) == moment(run_ts).cast(target.schema[names.valid_to].dataType)
    closed_twice = history.filter(ended).alias("h").join(current.alias("t"), same, "left_semi")
    if closed_twice.isEmpty():
        return
    same = same & (field("h", names.valid_to) == moment(run_ts).cast(target.schema[names.valid_to].dataType))
    kept = staged(history.alias("h").join(current.alias("t"), same, "left_anti"), "history")
    if kept.isEmpty():
        commit.drop_partitions(spark, name, names.is_current, ["false"])
    else:
        commit.replace_partitions(kept, name)


def equal_version(left: str, right: str, columns: list[str]):
    condition = F.lit(True)
    for name in columns:
        condition = condition & field(left, name).eqNullSafe(field(right, name))
    return condition


def _snapshot(spark, config: Snapshot, run):
    """The table is partitioned by snapshot time: taking one appends a partition, and
    pruning drops partitions through the catalog without reading any data."""
    stamp = config.snapshot_timestamp_column
    rows = snapshot_rows(
        source_frame(spark, config),
        run.run_ts,
        run.snapshot_id,
        timestamp_column=stamp,
        id_column=config.snapshot_id_column,
        keys=config.unique_key,
        dedupe_order_by=config.dedupe_order_by or None,
    )
    first = not commit.table_exists(spark, config.target_table)
    if first:
        commit.create(rows, config.target_table, [stamp])
    else:
        rows = conform(rows, _target(spark, config))
        if commit.partition_columns(spark, config.target_table) == [stamp]:
            commit.replace_partitions(rows, config.target_table)  # a repeated run replaces its own partition
        else:
            commit.append(rows, config.target_table)
        if config.retain_snapshots and commit.partition_columns(spark, config.target_table) != [stamp]:
            commit.rewrite(prune_snapshots(_target(spark, config), stamp, config.retain_snapshots), config.target_table)
        elif config.retain_snapshots:
            stamps = sorted((v for v in commit.partition_values(spark, config.target_table) if v), reverse=True)
            commit.drop_partitions(spark, config.target_table, stamp, stamps[config.retain_snapshots :])
    return "snapshot", {"first_run": first, "snapshot_id": run.snapshot_id}


def _append_only(spark, config: AppendOnly, run):
    source = source_frame(spark, config)
    first = not commit.table_exists(spark, config.target_table)
    if first:
        commit.create(source, config.target_table)
    else:
        commit.append(conform(source, _target(spark, config)), config.target_table)
    return "append_only", {"first_run": first}


def _view(spark, config: View, run):
    if isinstance(config.source, DataFrame) or config.params:
        raise ValueError("a view needs plain SQL text as its source")
    spark.sql(f"CREATE OR REPLACE VIEW {commit.table_name(config.target_table)} AS {config.source}")
    return "view", {}


_HANDLERS: dict[type, Callable] = {
    FullRefresh: _full_refresh,
    Incremental: _incremental,
    Partitioned: _partitioned,
    Scd1: _scd1,
    Scd2: _scd2,
    Snapshot: _snapshot,
    AppendOnly: _append_only,
    View: _view,
}
