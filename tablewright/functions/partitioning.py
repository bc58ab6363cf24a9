"""Partition values by date granularity, by range bounds, or by list membership."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

GRANULARITIES = ("hour", "day", "month", "year")
OTHER = "__other__"


def date_partition(source: Column, granularity: str) -> Column:
    """Start of the hour, day, month or year; a DATE except for hours.

    Hours become ``yyyy-MM-dd-HH`` text, which is safe in a directory name.
    """
    if granularity not in GRANULARITIES:
        raise ValueError(f"granularity {granularity!r} is not one of {GRANULARITIES}")
    if granularity == "hour":
        return F.date_format(source, "yyyy-MM-dd-HH")
    return F.to_date(F.date_trunc(granularity, source))


def range_partition(source: Column, bounds: Sequence) -> Column:
    """Bucket 0 lies below the first bound, bucket i from bound i-1 (inclusive) on.

    NULL stays NULL, as a partition of its own.
    """
    if not bounds or list(bounds) != sorted(set(bounds)):
        raise ValueError("range bounds must be given in strictly rising order")
    bucket = F.when(source < F.lit(bounds[0]), F.lit(0))
    for number, bound in enumerate(bounds[1:], start=1):
        bucket = bucket.when(source < F.lit(bound), F.lit(number))
    return F.when(source.isNotNull(), bucket.otherwise(F.lit(len(bounds))))


def list_partition(source: Column, values: Sequence) -> Column:
    """The value itself where listed, ``__other__`` elsewhere, NULL for NULL."""
    if not values:
        raise ValueError("list partitioning needs at least one value")
    text = source.cast("string")
    return F.when(source.isin(list(values)), text).when(source.isNotNull(), F.lit(OTHER))
