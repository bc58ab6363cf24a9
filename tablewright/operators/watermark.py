"""High-water-mark filters for incremental sources."""

from __future__ import annotations

from datetime import datetime, timedelta, timezone
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import TimestampNTZType, TimestampType

from ..functions.columns import column


_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def high_watermark(target: DataFrame, name: str) -> Any:
    """The greatest value of the column, or None. One row comes to the driver.

    An instant (TIMESTAMP) comes with its time zone, a TIMESTAMP_NTZ as the text Spark gives
    it, so neither passes through the time zone of the Python process.
    """
    kind, greatest = target.schema[name].dataType, F.max(column(name))
    if isinstance(kind, TimestampType):
        micros = target.agg(F.unix_micros(greatest).alias("mark")).first()["mark"]
        return None if micros is None else _EPOCH + timedelta(microseconds=micros)
    if isinstance(kind, TimestampNTZType):
        greatest = greatest.cast("string")
    return target.agg(greatest.alias("mark")).first()["mark"]


def newer_than(source: DataFrame, name: str, mark: Any) -> DataFrame:
    """Rows strictly above the mark, as a typed literal that reaches the file scan.

    Ties and NULLs are dropped. Without a mark (the target is empty) every row passes; a
    mark of zero is a mark.
    """
    if mark is None:
        return source
    kind = source.schema[name].dataType
    if isinstance(mark, datetime) and mark.tzinfo is None:
        mark = mark.isoformat(sep=" ")
    return source.filter(column(name) > F.lit(mark).cast(kind))


def newer_than_target(source: DataFrame, target: DataFrame, name: str) -> DataFrame:
    """The same filter as one lazy plan: the mark is a scalar subquery over the target."""
    mark = target.agg(F.max(column(name)).alias("mark")).scalar()
    return source.filter(mark.isNull() | (column(name) > mark))
