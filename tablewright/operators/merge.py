"""Keyed and keyless incremental transitions: merge, delete+insert, overwrite, append.

How the plans behave on large tables
------------------------------------
* The target is only ever the *left* side of a left or anti join. A small source is
  broadcast by Spark's own size check and the target is then scanned without a shuffle.
  With a large source both sides shuffle on the key, and adaptive execution splits a hot
  target key over tasks. It can do so only where nothing stands between the join and the
  shuffles under it, so no window or aggregate is placed there (see :func:`own_shuffle`).
* Which source rows are new is found through the distinct target keys, combined before
  their shuffle, never by shuffling whole target rows a second time.
* The one-row-per-key guard keeps at most two rows per key and task ahead of the shuffle,
  so one key holding much of the source does not land in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.columns import assigned, column, equal_keys, field, has_key, key_list
from .schema import align_schemas, conform

_HIT = "__matched"
_ROW = "__row_in_key"


def latest_per_key(
    df: DataFrame, keys: str | Sequence[str], order_by: str | Sequence[str]
) -> DataFrame:
    """The row with the greatest ``order_by`` for each key ("last one wins")."""
    keys = key_list(keys)
    newest = [column(c).desc_nulls_last() for c in key_list(order_by)]
    window = Window.partitionBy(*[column(k) for k in keys]).orderBy(*newest)
    return df.withColumn(_ROW, F.row_number().over(window)).filter(F.col(_ROW) == 1).drop(_ROW)


def single_row_per_key(df: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """``df`` unchanged, but the query fails if any key occurs twice.

    The test is part of the plan, not a second pass over the source.
    """
    keys = key_list(keys)
    window = Window.partitionBy(*[column(k) for k in keys]).orderBy(*[column(k) for k in keys])
    complaint = F.concat(
        F.lit(f"duplicate source key ({', '.join(keys)}): "),
        F.concat_ws(", ", *[column(k).cast("string") for k in keys]),
    )
    unique = F.when(F.col(_ROW) == 1, F.lit(True)).otherwise(F.raise_error(complaint).cast("boolean"))
    return df.withColumn(_ROW, F.row_number().over(window)).filter(F.col(_ROW) <= 2).filter(unique).drop(_ROW)


def own_shuffle(df: DataFrame) -> DataFrame:
    """End the partitioning of a window or aggregate, so a join above shuffles afresh.

    For the side whose size is that of the source. It lets adaptive execution split hot
    keys of the other, larger side.
    """
    return df.hint("rebalance")


@dataclass(frozen=True)
class KeyedSource:
    """A source split by whether a row has a full key.

    Rows lacking a key match nothing, are never duplicates of each other, and may be very
    many; keeping them out of the keyed joins keeps them out of one task.
    """

    matching: DataFrame  # rows with a key, for joins against the target
    checked: DataFrame  # the same rows, the query failing if a key repeats
    unkeyed: DataFrame

    def select(self, *columns) -> KeyedSource:
        return KeyedSource(*[df.select(*columns) for df in (self.matching, self.checked, self.unkeyed)])


def keyed_source(
    source: DataFrame,
    keys: Sequence[str],
    dedupe_order_by: str | Sequence[str] | None = None,
) -> KeyedSource:
    """Prepare a source for keyed joins.

    A repeated key is resolved by ``dedupe_order_by``, or else fails the query: the check
    rides on the rows that look for their insertion, so the join that updates the target
    stays free of it.
    """
    with_key, unkeyed = source.filter(has_key(keys)), source.filter(~has_key(keys))
    if dedupe_order_by:
        latest = own_shuffle(latest_per_key(with_key, keys, dedupe_order_by))
        return KeyedSource(latest, latest, unkeyed)
    return KeyedSource(with_key, single_row_per_key(with_key, keys), unkeyed)


def one_row_per_key(source: DataFrame, keys: Sequence[str], dedupe_order_by: str | Sequence[str] | None = None) -> DataFrame:
    """The whole source with repeated keys resolved or refused; rows without a key stay."""
    parts = keyed_source(source, keys, dedupe_order_by)
    return parts.checked.unionByName(parts.unkeyed)


def _no_repeats(source: DataFrame, keys: Sequence[str], target: DataFrame) -> DataFrame:
    """No rows, but the query fails if a key of ``source`` repeats.

    A branch of its own, so that it runs whatever becomes of the joins; counts are combined
    before their shuffle.
    """
    counted = source.groupBy(*[column(k).alias(f"k{n}") for n, k in enumerate(keys)]).agg(F.count(F.lit(1)).alias("rows"))
    key = F.concat_ws(", ", *[F.col(f"k{n}").cast("string") for n in range(len(keys))])
    complaint = F.raise_error(F.concat(F.lit(f"duplicate source key ({', '.join(keys)}): "), key)).cast("boolean")
    none = counted.filter(F.when(F.col("rows") > 1, complaint).otherwise(F.lit(False)))
    return none.select(*[F.lit(None).cast(f.dataType).alias(f.name) for f in target.schema.fields])


def not_older(order_by: str | Sequence[str], target: DataFrame) -> Callable[[str, str], Column]:
    """The condition that a source row does not come before the target's, NULLs coming first."""
    columns = key_list(order_by)
    lacking = [c for c in columns if c not in target.columns]
    if not columns or lacking:
        raise ValueError(f"the newest row can only win by order columns that the target has: {lacking or 'none given'}")

    def rank(alias: str) -> Column:
        parts = [F.struct(field(alias, c).isNotNull().alias(f"set{k}"), field(alias, c).alias(f"v{k}")) for k, c in enumerate(columns)]
        return F.struct(*[p.alias(f"c{k}") for k, p in enumerate(parts)])

    return lambda t, s: rank(s) >= rank(t)


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    *,
    update_if: Callable[[str, str], Column] | None = None,
    stamps: Mapping[str, Column] | None = None,
    dedupe_order_by: str | Sequence[str] | None = None,
    matched_keys: DataFrame | None = None,
) -> DataFrame:
    """Update matched rows, insert unmatched source rows, keep the rest of the target.

    ``update_if(target_alias, source_alias)`` restricts the update; ``stamps`` are audit
    columns set on every row that is updated or inserted. Result columns and types are
    the target's; target columns the source lacks keep their value or are NULL on insert,
    and source columns the target lacks serve at most to order duplicates. ``matched_keys``,
    the distinct source keys that the target has, are looked up unless given.
    """
    keys = key_list(keys)
    if not keys:
        raise ValueError("an upsert needs at least one key column")
    stamps = dict(stamps or {})
    shared = [c for c in source.columns if c in target.columns]
    rows = keyed_source(source, keys, dedupe_order_by).select(*shared)

    joined = target.alias("t").join(
        rows.matching.withColumn(_HIT, F.lit(True)).alias("s"), equal_keys("t", "s", keys), "left"
    )
    touched = field("s", _HIT).isNotNull()
    given = {f.name: f.dataType for f in source.schema.fields}
    if update_if is not None:
        touched = touched & update_if("t", "s")

    def after(f):
        old = field("t", f.name)
        if f.name in stamps:
            new = stamps[f.name].cast(f.dataType)
        elif f.name in shared and f.name not in keys:
            new = assigned(field("s", f.name), given[f.name], f.dataType, f.name)
        else:
            return old
        return F.when(touched, new).otherwise(old).alias(f.name)

    updated = joined.select(*[after(f) for f in target.schema.fields])
    if matched_keys is None:
        # Spark moves the semi join below the distinct when it can broadcast the source.
        matched_keys = target.select(*keys).distinct().join(source.select(*keys), keys, "left_semi")
    fresh = rows.matching.join(matched_keys, keys, "left_anti").unionByName(rows.unkeyed)
    inserted = conform(fresh.withColumns(stamps) if stamps else fresh, target)
    after = updated.unionByName(inserted)
    return after if dedupe_order_by else after.unionByName(_no_repeats(rows.matching, keys, target))


def merge(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    *,
    on_schema_change: str = "append_new_columns",
    dedupe_order_by: str | Sequence[str] | None = None,
    newest_wins: bool = False,
) -> DataFrame:
    """Every non-key source column overwrites matched rows; new keys are inserted by name.

    With ``newest_wins`` a row that ``dedupe_order_by`` puts before the target's changes nothing.
    """
    keys = key_list(keys)
    update_if = not_older(dedupe_order_by or "", target) if newest_wins else None
    target, _ = align_schemas(target, source, on_schema_change, keys)
    return upsert(target, source, keys, update_if=update_if, dedupe_order_by=dedupe_order_by)


def delete_insert(target: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Drop target rows whose key is in the source, then add every source row, copies included."""
    keys = key_list(keys)
    if not keys:
        raise ValueError("delete+insert needs at least one key column")
    delivered = own_shuffle(source.select(*keys).distinct())
    kept = target.join(delivered, keys, "left_anti").select(*target.columns)
    return kept.unionByName(conform(source, target))


def overwrite_by_value(target: DataFrame, source: DataFrame, partition_column: str) -> DataFrame:
    """Replace the target rows whose partition value the source delivers.

    The distinct delivered values meet the target in an anti join, which Spark broadcasts
    when they are few by its own size check. A NULL partition value never matches, so old
    NULL rows stay. For a table that is physically partitioned the commit does all this
    without reading the target.
    """
    value = column(partition_column)
    delivered = own_shuffle(source.select(value).filter(value.isNotNull()).distinct())
    kept = target.join(delivered, [partition_column], "left_anti").select(*target.columns)
    return kept.unionByName(conform(source, target))


def append_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Every row of both, by column name."""
    return target.unionByName(conform(source, target))
