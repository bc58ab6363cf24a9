"""Slowly changing dimensions: overwrite (type 1) and versioned history (type 2)."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from datetime import date, datetime
from math import log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampType

from ..functions.columns import any_difference, assigned, column, equal_keys, field, key_list, moment, row_hash
from .merge import keyed_source, not_older, upsert

_NEW_HASH = "__new_hash"
_OPEN = "__still_open"


def scd1_initial(source: DataFrame, run_ts: datetime | str, updated_at: str = "updated_at") -> DataFrame:
    return source.withColumn(updated_at, moment(run_ts))


def scd1(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    run_ts: datetime | str,
    *,
    updated_at: str = "updated_at",
    dedupe_order_by: str | Sequence[str] | None = None,
    newest_wins: bool = False,
) -> DataFrame:
    """Overwrite a matched row whole when a tracked column changed, and stamp it.

    An unchanged row stays as it is even if an untracked column differs. With no tracked
    columns every match is overwritten. New keys are inserted; nothing is deleted.
    """
    changed = (lambda t, s: any_difference(t, s, tracked)) if tracked else None
    if newest_wins:
        newer, differs = not_older(dedupe_order_by or "", target), changed
        changed = (lambda t, s: newer(t, s) & differs(t, s)) if differs else newer
    return upsert(
        target,
        source,
        keys,
        update_if=changed,
        stamps={updated_at: moment(run_ts)},
        dedupe_order_by=dedupe_order_by,
    )


@dataclass(frozen=True)
class VersionColumns:
    """Names of the four columns that make a row a version."""

    valid_from: str = "valid_from"
    valid_to: str = "valid_to"
    is_current: str = "is_current"
    row_hash: str = "row_hash"


@dataclass(frozen=True)
class Scd2Parts:
    """The three disjoint parts of the next state of a versioned table."""

    history: DataFrame  # versions closed by earlier runs, untouched
    closed: DataFrame  # versions this run closes
    current: DataFrame  # one open version per key


def scd2_initial(
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    run_ts: datetime | str,
    names: VersionColumns = VersionColumns(),
) -> DataFrame:
    """First run: every source row becomes an open version."""
    keys = key_list(keys)
    hashed = list(tracked) or [c for c in source.columns if c not in keys]
    return source.select(
        "*",
        moment(run_ts).alias(names.valid_from),
        F.lit(None).cast("timestamp_ntz").alias(names.valid_to),
        F.lit(True).alias(names.is_current),
        row_hash(hashed).alias(names.row_hash),
    )


def _judged(target, source, keys, tracked, run_ts, names, close_missing, dedupe_order_by):
    """(current slice with a still-open flag, versions to open)."""
    if not keys:
        raise ValueError("a versioned dimension needs at least one key column")
    shared = [c for c in source.columns if c in target.columns]
    new_hash = row_hash(list(tracked) or [c for c in shared if c not in keys]).alias(_NEW_HASH)
    rows = keyed_source(source, keys, dedupe_order_by).select(*shared, new_hash)
    current = target.filter(_is_open(names)).alias("t")
    changed = F.coalesce(field("t", names.row_hash) != field("s", _NEW_HASH), F.lit(False))

    # no source row: open unless missing keys are closed; else open while the hashes agree
    still_open = F.when(field("s", _NEW_HASH).isNull(), F.lit(not close_missing)).otherwise(~changed)
    incoming = rows.matching.select(*keys, _NEW_HASH).alias("s")
    judged = current.join(incoming, equal_keys("t", "s", keys), "left").select("t.*", still_open.alias(_OPEN))

    # A source key with an open version left needs no new one.
    open_hashes = target.filter(_is_open(names)).select(*keys, names.row_hash).distinct().alias("t")
    unchanged = open_hashes.join(incoming, equal_keys("t", "s", keys) & ~changed, "left_semi").select(*keys)
    fresh = rows.checked.join(unchanged, keys, "left_anti").unionByName(rows.unkeyed)
    return judged, _opened_like(target, fresh, run_ts, names)


def _is_open(names: VersionColumns) -> Column:
    return F.coalesce(column(names.is_current), F.lit(False))


def _opened_like(target: DataFrame, fresh: DataFrame, run_ts, names: VersionColumns) -> DataFrame:
    """New versions in the target's column order and types; target-only columns are NULL."""
    version = {
        names.valid_from: moment(run_ts),
        names.valid_to: F.lit(None),
        names.is_current: F.lit(True),
        names.row_hash: F.col(_NEW_HASH),
    }
    own = {f.name: f.dataType for f in fresh.schema.fields}

    def value(f) -> Column:
        if f.name in own and f.name not in version:
            return assigned(column(f.name), own[f.name], f.dataType, f.name)
        return version.get(f.name, F.lit(None)).cast(f.dataType)

    return fresh.select(*[value(f).alias(f.name) for f in target.schema.fields])


def scd2_parts(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    run_ts: datetime | str,
    *,
    names: VersionColumns = VersionColumns(),
    close_missing: bool = True,
    dedupe_order_by: str | Sequence[str] | None = None,
) -> Scd2Parts:
    """Next state of a versioned table, as history / closed / current.

    Only the current slice is joined; history is passed through. On a table partitioned by
    the current flag the history is then not even read.
    """
    keys = key_list(keys)
    judged, opened = _judged(target, source, keys, tracked, run_ts, names, close_missing, dedupe_order_by)
    end = moment(run_ts).cast(target.schema[names.valid_to].dataType)
    closed = (
        judged.filter(~F.col(_OPEN))
        .withColumns({names.valid_to: end, names.is_current: F.lit(False)})
        .select(*target.columns)
    )
    kept = judged.filter(F.col(_OPEN)).select(*target.columns)
    return Scd2Parts(
        history=target.filter(~_is_open(names)), closed=closed, current=kept.unionByName(opened)
    )


def scd2(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    tracked: Sequence[str],
    run_ts: datetime | str,
    *,
    names: VersionColumns = VersionColumns(),
    close_missing: bool = True,
    dedupe_order_by: str | Sequence[str] | None = None,
) -> DataFrame:
    """The whole next state of a versioned table in one plan.

    After it each source key has one open version with the source's tracked values, closed
    rows end at ``run_ts``, and earlier history is unchanged.
    """
    keys = key_list(keys)
    judged, opened = _judged(target, source, keys, tracked, run_ts, names, close_missing, dedupe_order_by)
    end = moment(run_ts).cast(target.schema[names.valid_to].dataType)
    kept = judged.withColumns(
        {
            names.valid_to: F.when(F.col(_OPEN), column(names.valid_to)).otherwise(end),
            names.is_current: F.col(_OPEN),
        }
    ).select(*target.columns)
    return target.filter(~_is_open(names)).unionByName(kept).unionByName(opened)


def current_rows(dimension: DataFrame, names: VersionColumns = VersionColumns()) -> DataFrame:
    return dimension.filter(column(names.is_current))


def as_of(
    dimension: DataFrame, when: Column | datetime | date | str, names: VersionColumns = VersionColumns()
) -> DataFrame:
    """Versions valid at ``when``: start inclusive, end exclusive, NULL end still open."""
    at = when if isinstance(when, Column) else moment(when)
    return dimension.filter(
        (column(names.valid_from) <= at)
        & (column(names.valid_to).isNull() | (column(names.valid_to) > at))
    )


def join_as_of(
    facts: DataFrame,
    dimension: DataFrame,
    keys: str | Sequence[str],
    at: str,
    names: VersionColumns = VersionColumns(),
    how: str = "left",
) -> DataFrame:
    """Join each fact to the version valid at its own time: an equi-join on the key.

    The validity interval is a residual condition, so a key meets only its own versions.
    """
    keys = key_list(keys)
    when = field("f", at)
    inside = (field("d", names.valid_from) <= when) & (
        field("d", names.valid_to).isNull() | (field("d", names.valid_to) > when)
    )
    attributes = [c for c in dimension.columns if c not in keys]
    return (
        facts.alias("f")
        .join(dimension.alias("d"), equal_keys("f", "d", keys) & inside, how)
        .select("f.*", *[field("d", c) for c in attributes])
    )


def _micros(value: Column, kind) -> Column:
    """Microseconds that grow with a date or time, whatever the session's time zone."""
    if isinstance(kind, TimestampType):
        return F.unix_micros(value)
    wall = value.cast("timestamp_ntz")
    second = (F.extract(F.lit("SECOND"), wall) * 1_000_000).cast("bigint")
    minutes = (F.hour(wall) * 60 + F.minute(wall)).cast("bigint")
    return F.datediff(wall, F.lit("1970-01-01")).cast("bigint") * 86_400_000_000 + minutes * 60_000_000 + second


#: How much wider the bins of each level of :func:`join_as_of_binned` are.
WIDER = 8
#: A level with fewer versions is copied until it has about so many, each copy for some of the facts.
SPREAD = 1024


def join_as_of_binned(
    facts: DataFrame,
    dimension: DataFrame,
    keys: str | Sequence[str],
    at: str,
    names: VersionColumns = VersionColumns(),
    how: str = "left",
) -> DataFrame:
    """:func:`join_as_of` for keys with very many versions, which must not overlap.

    Time is cut into bins, on levels of growing width; the narrowest is about as wide as the
    shortest tenth of versions last. A closed version lies on the level whose bins are as wide as it is long,
    in two of them at most, an open one on a level of its own. A fact looks up one bin on each level, so
    it meets the versions of that bin instead of all of its key, and the facts of a key are spread over
    tasks by time. A level of few versions, such as the open ones of a few keys, would leave few groups for
    all facts; it is copied under ``SPREAD`` numbers in all, and a fact looks up the copy of its time's hash.
    Levels are as many as powers of ``WIDER`` between the shortest and the longest version; their numbers
    and sizes come to the driver.
    """
    keys = key_list(keys)
    if how not in ("left", "inner"):
        raise ValueError(f"how {how!r} is neither 'left' nor 'inner'")
    attributes = [c for c in dimension.columns if c not in keys]
    taken = {*facts.columns, *dimension.columns}

    def unused(name: str) -> str:
        while name in taken:
            name = "_" + name
        taken.add(name)
        return name

    begin, end, level, bin_, copy, found = map(unused, ("__begin", "__end", "__level", "__bin", "__copy", "__found"))
    kind = dimension.schema[names.valid_from].dataType
    closed = column(names.valid_to).isNotNull()
    timed = dimension.filter(column(names.valid_from).isNotNull()).withColumns(
        {begin: _micros(column(names.valid_from), kind), end: _micros(column(names.valid_to), kind)}
    )
    length = F.greatest(F.col(end) - F.col(begin), F.lit(1))
    width = timed.filter(closed).agg(F.percentile_approx(length, 0.1)).first()[0] or 1
    power = F.greatest(F.ceil(F.log(length / F.lit(float(width))) / F.lit(log(WIDER))), F.lit(0)).cast("int")
    leveled = timed.withColumn(level, F.when(closed, power).otherwise(F.lit(-1)))
    levels = sorted(tuple(r) for r in leveled.groupBy(level).count().collect())  # a few dozen at most
    met = facts
    when_kind = facts.schema[at].dataType
    columns = []
    for k, count in levels:
        size = F.lit(int(width) * WIDER**k if k >= 0 else 1)
        versions = leveled.filter(F.col(level) == k)
        if k >= 0:
            bins = F.sequence(F.floor(F.col(begin) / size), F.floor(F.col(end) / size))
            versions = versions.withColumn(bin_, F.explode(bins))
        copies = -(-SPREAD // count)
        if copies > 1:
            versions = versions.withColumn(copy, F.explode(F.sequence(F.lit(0), F.lit(copies - 1))))
        payload = unused(f"__version{k}".replace("-", "o"))
        columns.append(payload)
        mine = versions.select(*keys, *([bin_] if k >= 0 else []), *([copy] if copies > 1 else []), F.struct(*[column(c) for c in attributes]).alias(payload))
        start, stop = F.col(f"d.{payload}.`{names.valid_from}`"), F.col(f"d.{payload}.`{names.valid_to}`")
        on = equal_keys("f", "d", keys) & (start <= field("f", at)) & (stop.isNull() | (stop > field("f", at)))
        looking = met
        if k >= 0:
            looking = met.withColumn(bin_, F.floor(_micros(column(at), when_kind) / size))
            on = on & (F.col(f"f.{bin_}") == F.col(f"d.{bin_}"))
        if copies > 1:
            looking = looking.withColumn(copy, F.pmod(F.xxhash64(column(at)), F.lit(copies)).cast("int"))
            on = on & (F.col(f"f.{copy}") == F.col(f"d.{copy}"))
        met = looking.alias("f").join(mine.alias("d"), on, "left").select(*[field("f", c) for c in met.columns], field("d", payload))
    version = F.coalesce(*[F.col(c) for c in columns]) if columns else F.struct(*[F.lit(None).cast(dimension.schema[c].dataType).alias(c) for c in attributes])
    met = met.withColumn(found, version)
    if how == "inner":
        met = met.filter(F.col(found).isNotNull() if columns else F.lit(False))
    return met.select(*[column(c) for c in facts.columns], *[F.col(f"{found}.`{c}`").alias(c) for c in attributes])


def key_history(dimension: DataFrame, predicate: Column, names: VersionColumns = VersionColumns()) -> DataFrame:
    """All versions of the keys that satisfy ``predicate``, oldest first."""
    return dimension.filter(predicate).orderBy(column(names.valid_from))


def version_changes(
    dimension: DataFrame,
    keys: str | Sequence[str],
    columns: Sequence[str],
    names: VersionColumns = VersionColumns(),
) -> DataFrame:
    """Each version with ``previous_<column>`` of the version it replaced, if any.

    A version replaces the one that ends where it starts, so this is an equi-join on key and
    time: a key with very many versions spreads over tasks, which a window would not allow.
    """
    keys = key_list(keys)
    replaced = equal_keys("n", "p", keys) & (field("p", names.valid_to) == field("n", names.valid_from))
    before = dimension.filter(column(names.valid_to).isNotNull()).select(*keys, names.valid_to, *columns)
    return (
        dimension.select(*keys, names.valid_from, names.valid_to, *columns)
        .alias("n")
        .join(before.alias("p"), replaced, "left")
        .select("n.*", *[field("p", c).alias(f"previous_{c}") for c in columns])
    )
