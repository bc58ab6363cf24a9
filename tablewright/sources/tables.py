"""Catalog tables: parameterized queries, loads in three modes, schema, statements."""

from __future__ import annotations

import warnings
from collections.abc import Mapping, Sequence
from typing import Any

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import key_list
from ..operators.merge import one_row_per_key, upsert
from ..operators.schema import conform, describe
from ..plans import commit
from ..scratch import discarding_stages, observed, staged


def extract(spark: SparkSession, query: str, params: Mapping[str, Any] | Sequence[Any] | None = None) -> DataFrame:
    """Run a query; values are bound by name (``:x``) or position (``?``), never pasted in."""
    if params is None:
        return spark.sql(query)
    return spark.sql(query, args=dict(params) if isinstance(params, Mapping) else list(params))


def execute(spark: SparkSession, statement: str, params: Mapping[str, Any] | None = None) -> None:
    """Run a statement for its effect."""
    spark.sql(statement, args=dict(params) if params else None).collect()


def table_schema(spark: SparkSession, table: str) -> DataFrame:
    return describe(spark.table(commit.table_name(table)))


def load(
    df: DataFrame,
    table: str,
    mode: str = "append",
    merge_key: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] | None = None,
) -> int:
    """Load rows into a catalog table, creating it with ``df``'s own types if absent.

    An empty ``df`` is a no-op in every mode: ``replace``, which swaps the contents, then
    leaves the old data. ``upsert`` needs ``merge_key``; where a key repeats, the row greatest in ``order_by``
    wins (without ``order_by`` a repeated key is an error). Anything else appends.
    Returns the number of rows given.
    """
    spark = df.sparkSession
    if mode not in ("append", "replace", "upsert"):
        warnings.warn(f"unknown load mode {mode!r}: appending", stacklevel=2)
    keys = key_list(merge_key)

    if df.isEmpty():
        return 0
    if mode == "upsert" and keys:
        with discarding_stages(spark):
            source = staged(df, "load")
            if commit.table_exists(spark, table):
                target = spark.table(commit.table_name(table))
                commit.rewrite(upsert(target, source, keys, dedupe_order_by=order_by), table)
            else:
                commit.create(one_row_per_key(source, keys, order_by), table)
            return source.count()

    if mode == "replace" and commit.table_exists(spark, table):
        with discarding_stages(spark):
            source = staged(df, "load")
            # the table keeps its columns; what the delivery lacks is NULL
            commit.rewrite(conform(source, spark.table(commit.table_name(table))), table)
            return source.count()
    given = Observation()
    counted = df.observe(given, F.count(F.lit(1)).alias("rows"))
    if not commit.table_exists(spark, table):
        commit.create(counted, table)
    else:
        commit.append(conform(counted, spark.table(commit.table_name(table))), table)
    return observed(given, "rows")


__all__ = ["execute", "extract", "load", "table_schema"]
