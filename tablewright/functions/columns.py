"""Expressions shared by the table transitions. All are built-in and JVM-side."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from datetime import date, datetime
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, DateType, DoubleType, FloatType, NumericType, TimestampNTZType, TimestampType


def key_list(keys: str | Iterable[str] | None) -> list[str]:
    """Accept ``"a, b"`` or ``["a", "b"]``; nothing given means no key."""
    if not keys:
        return []
    parts = keys.split(",") if isinstance(keys, str) else keys
    return [name for name in (part.strip() for part in parts) if name]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(alias: str, name: str) -> Column:
    """Column ``name`` of the DataFrame aliased ``alias``."""
    return F.col(f"{quoted(alias)}.{quoted(name)}")


def column(name: str) -> Column:
    return F.col(quoted(name))


def has_key(keys: Sequence[str]) -> Column:
    """True where every key column is set. A row without a full key matches nothing."""
    return reduce(and_, (column(k).isNotNull() for k in keys))


def equal_keys(left: str, right: str, keys: Sequence[str]) -> Column:
    """Plain equality on every key, so NULL keys never match."""
    return reduce(and_, (field(left, k) == field(right, k) for k in keys))


def any_difference(left: str, right: str, columns: Sequence[str]) -> Column:
    """NULL-safe ``IS DISTINCT FROM``, OR-ed over the columns."""
    return reduce(or_, (~field(left, c).eqNullSafe(field(right, c)) for c in columns))


def assigned(value: Column, given: DataType, wanted: DataType, name: str) -> Column:
    """``value`` as the type of the table column ``name``; the query fails if that loses any of it.

    A number must keep its value (a double of 2.0 may become an integer, 1.9 may not), a time
    that becomes a date must be midnight. Floating point columns take the nearest value.
    """
    cast = value.cast(wanted)
    if given == wanted:
        return cast
    number = isinstance(given, NumericType) and isinstance(wanted, NumericType) and not isinstance(wanted, (FloatType, DoubleType))
    day = isinstance(given, (TimestampType, TimestampNTZType)) and isinstance(wanted, DateType)
    if not number and not day:
        return cast
    tried = value.try_cast(wanted)
    complaint = F.concat(F.lit(f"{name} is {wanted.simpleString()}, which cannot hold "), value.cast("string"))
    return F.when(tried.cast(given).eqNullSafe(value), tried).otherwise(F.raise_error(complaint).cast(wanted))


def row_hash(columns: Sequence[str]) -> Column:
    """MD5 of the columns' text joined by ``|``; NULL and ``''`` hash alike.

    ``coalesce`` comes first because ``concat_ws`` would skip a NULL and shift its
    neighbours together.
    """
    texts = [F.coalesce(column(c).cast("string"), F.lit("")) for c in columns]
    return F.md5(F.concat_ws("|", *texts))


def moment(value: datetime | date | str) -> Column:
    """A constant TIMESTAMP_NTZ, independent of the Python and session time zones."""
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ValueError("give run timestamps without a time zone")
        value = value.isoformat(sep=" ")
    return F.lit(str(value)).cast("timestamp_ntz")
