"""Data checks and freshness as small result tables, each from one aggregate pass."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from datetime import datetime, timedelta
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import column, has_key, key_list, moment


class CheckFailed(AssertionError):
    """At least one expectation did not hold."""


@dataclass(frozen=True)
class Expectation:
    """A name and an aggregate that counts the rows violating it."""

    name: str
    failed_rows: Column


def not_null(name: str) -> Expectation:
    return Expectation(f"not_null({name})", F.count_if(column(name).isNull()))


def in_set(name: str, allowed: Sequence) -> Expectation:
    """NULL is not in any set."""
    outside = ~F.coalesce(column(name).isin(list(allowed)), F.lit(False))
    return Expectation(f"in_set({name})", F.count_if(outside))


def unique(keys: str | Sequence[str]) -> Expectation:
    """Counts the rows beyond the first of each key; rows without a full key do not count."""
    keys = key_list(keys)
    distinct = F.count_distinct(*[column(k) for k in keys])
    return Expectation(f"unique({','.join(keys)})", F.count_if(has_key(keys)) - distinct)


def min_rows(least: int) -> Expectation:
    """Counts how many rows are lacking."""
    return Expectation(f"min_rows({least})", F.greatest(F.lit(least) - F.count(F.lit(1)), F.lit(0)))


def expect(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """(check_name, failed_rows, passed) for all expectations, from one pass over ``df``."""
    if not expectations:
        raise ValueError("no expectations given")
    counts = df.agg(*[e.failed_rows.cast("bigint").alias(f"c{i}") for i, e in enumerate(expectations)])
    results = F.array(
        *[
            F.struct(F.lit(e.name).alias("check_name"), F.col(f"c{i}").alias("failed_rows"))
            for i, e in enumerate(expectations)
        ]
    )
    return (
        counts.select(F.explode(results).alias("r"))
        .select("r.check_name", "r.failed_rows")
        .withColumn("passed", F.col("failed_rows") == 0)
    )


def enforce(df: DataFrame, expectations: Sequence[Expectation]) -> DataFrame:
    """Raise :class:`CheckFailed` naming every broken expectation, else return ``df``."""
    broken = expect(df, expectations).filter(~F.col("passed")).collect()  # one row per check
    if broken:
        raise CheckFailed("; ".join(f"{r.check_name}: {r.failed_rows} rows" for r in broken))
    return df


def freshness(
    tables: Mapping[str, tuple[DataFrame, str]], run_ts: datetime | str, max_lag: timedelta
) -> DataFrame:
    """(table_name, last_updated, lag_seconds, status) with status fresh, stale or empty.

    Each table contributes one column-pruned ``max``.
    """
    if not tables:
        raise ValueError("no tables given")
    newest = [
        df.agg(F.max(column(name)).cast("timestamp_ntz").alias("last_updated")).select(
            F.lit(table).alias("table_name"), "last_updated"
        )
        for table, (df, name) in tables.items()
    ]
    lag = F.timestamp_diff("SECOND", F.col("last_updated"), moment(run_ts))
    limit = F.lit(int(max_lag.total_seconds()))
    return (
        reduce(DataFrame.unionByName, newest)
        .withColumn("lag_seconds", lag)
        .withColumn(
            "status",
            F.when(F.col("last_updated").isNull(), F.lit("empty"))
            .when(F.col("lag_seconds") <= limit, F.lit("fresh"))
            .otherwise(F.lit("stale")),
        )
    )
