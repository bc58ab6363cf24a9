"""External databases through Spark's JDBC source, or a vendor's own Spark connector.

The vendor's jar must be on the cluster's class path. Reads are split over executors by a
numeric, date or timestamp column, in even ranges (``split``) or ranges of equally many rows
(``cuts``, see :func:`cut_points`); writes go out in batches from every partition.

Spark hands a database the text of a query, without parameters of its own. :func:`bound` puts
values into it as literals of their type, only where a name stands outside of quotes and comments.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Mapping, Sequence
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from ..functions.columns import key_list
from ..operators.merge import one_row_per_key
from ..scratch import discarding_stages, staged

# The public driver class or Spark format name of each vendor.
JDBC_DRIVERS = {
    "postgres": "org.postgresql.Driver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "redshift": "com.amazon.redshift.jdbc42.Driver",
    "snowflake": "net.snowflake.client.jdbc.SnowflakeDriver",
    "duckdb": "org.duckdb.DuckDBDriver",
    "clickhouse": "com.clickhouse.jdbc.ClickHouseDriver",
}
SPARK_FORMATS = {"bigquery": "bigquery"}


def connection(vendor: str, url: str = "", **options: Any) -> tuple[str, dict[str, str]]:
    """(Spark format, options) for a vendor. Options pass through unchanged."""
    given = {k: str(v) for k, v in options.items()}
    if vendor in SPARK_FORMATS:
        return SPARK_FORMATS[vendor], given
    if vendor not in JDBC_DRIVERS:
        known = sorted([*JDBC_DRIVERS, *SPARK_FORMATS])
        raise ValueError(f"unknown vendor {vendor!r}, expected one of {known}")
    return "jdbc", {"url": url, "driver": JDBC_DRIVERS[vendor], **given}


#: Vendors whose quoted text takes backslashes as escapes.
_BACKSLASH = ("mysql", "clickhouse", "bigquery", "snowflake")


def sql_literal(value: Any, vendor: str = "ansi") -> str:
    """A value as a literal of its type. Values that have none are refused."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (int, Decimal)) or isinstance(value, float) and math.isfinite(value):
        if isinstance(value, Decimal) and not value.is_finite():
            raise ValueError(f"{value} has no literal")
        return f"({value})" if value < 0 else str(value)
    if isinstance(value, datetime):
        if value.tzinfo is not None:
            raise ValueError("give a time without zone, in the database's own")
        return f"TIMESTAMP '{value.isoformat(sep=' ')}'"
    if isinstance(value, date):
        return f"DATE '{value.isoformat()}'"
    if isinstance(value, str):
        if "\0" in value:
            raise ValueError("text with a zero character has no literal")
        return "'" + (value.replace("\\", "\\\\") if vendor in _BACKSLASH else value).replace("'", "''") + "'"
    if isinstance(value, (list, tuple)) and value:
        return "(" + ", ".join(sql_literal(v, vendor) for v in value) + ")"
    raise ValueError(f"a {type(value).__name__} has no literal")


def bound(query: str, params: Mapping[str, Any], vendor: str = "ansi") -> str:
    """``query`` with every ``:name`` replaced by the literal of its value; a list is for ``IN :name``.

    Names inside quotes and comments, and casts (``::date``), are left alone. A name without a value,
    and a value that no name asks for, are errors.
    """
    text = r"'(?:[^'\\]|\\.|'')*+'" if vendor in _BACKSLASH else r"'(?:[^']|'')*+'"
    token = re.compile(rf"""{text}|"[^"]*+"|`[^`]*+`|--[^\n]*+|/\*.*?\*/|::|:([A-Za-z_]\w*)""", re.DOTALL)
    used = set()

    def put(found: re.Match) -> str:
        name = found.group(1)
        if name is None:
            return found.group()
        if name not in params:
            raise ValueError(f"no value for :{name}")
        used.add(name)
        return sql_literal(params[name], vendor)

    done = token.sub(put, query)
    if unused := sorted(set(params) - used):
        raise ValueError(f"the query does not ask for {unused}")
    return done


def cut_statement(query: str, column: str, partitions: int) -> str:
    """The greatest value of each of ``partitions`` parts with equally many rows."""
    return (
        f"SELECT part, MAX({column}) AS cut FROM (SELECT {column}, NTILE({int(partitions)}) OVER (ORDER BY {column}) AS part"
        f" FROM ({query}) source_rows WHERE {column} IS NOT NULL) parts GROUP BY part"
    )


def cut_points(spark: SparkSession, source: tuple[str, Mapping[str, str]], query: str, column: str, partitions: int) -> list:
    """Values that cut the rows of ``query`` into at most ``partitions`` parts of equal size; the database finds
    them. A value that holds more than a part's rows gives fewer parts."""
    rows = read_query(spark, source, cut_statement(query, column, partitions)).collect()  # one row per part
    return sorted({r["cut"] for r in rows})[:-1]


def cut_predicates(column: str, cuts: Sequence[Any], vendor: str = "ansi") -> list[str]:
    """Conditions of which every row, NULLs among them, meets exactly one."""
    if not cuts:
        return ["1 = 1"]
    ends = [sql_literal(c, vendor) for c in sorted(set(cuts))]
    between = [f"{column} > {a} AND {column} <= {b}" for a, b in zip(ends, ends[1:], strict=False)]
    return [f"{column} <= {ends[0]} OR {column} IS NULL", *between, f"{column} > {ends[-1]}"]


def split_options(query: str, column: str, lower: Any, upper: Any, partitions: int) -> dict[str, str]:
    """Read ``query`` as ``partitions`` parallel ranges of ``column``.

    The bounds only place the cuts; rows outside them and NULLs are read as well.
    """
    return {
        "dbtable": f"({query}) source_rows",
        "partitionColumn": column,
        "lowerBound": str(lower),
        "upperBound": str(upper),
        "numPartitions": str(partitions),
    }


def read_query(
    spark: SparkSession,
    source: tuple[str, Mapping[str, str]],
    query: str,
    split: tuple[str, Any, Any, int] | None = None,
    fetch_size: int = 10_000,
    *,
    cuts: tuple[str, Sequence[Any]] | None = None,
    params: Mapping[str, Any] | None = None,
    vendor: str = "ansi",
) -> DataFrame:
    """Rows of a query. Without ``split`` (column, lower, upper, partitions) or ``cuts`` (column, values
    from :func:`cut_points`) one task reads them. ``params`` are put in by :func:`bound`."""
    format, options = source
    if split and cuts:
        raise ValueError("give split or cuts, not both")
    if params:
        query = bound(query, params, vendor)
    if cuts:
        rest = {k: v for k, v in options.items() if k != "url"} | {"fetchsize": str(fetch_size)}
        return spark.read.jdbc(options["url"], f"({query}) source_rows", predicates=cut_predicates(*cuts, vendor), properties=rest)
    read = split_options(query, *split) if split else {"query": query}
    return spark.read.format(format).options(**options, **read, fetchsize=fetch_size).load()


def write_table(
    df: DataFrame,
    source: tuple[str, Mapping[str, str]],
    table: str,
    mode: str = "append",
    connections: int = 16,
    batch_size: int = 10_000,
) -> None:
    """``append``, or ``replace`` by truncating and inserting; replacing by nothing is a no-op.

    At most ``connections`` tasks write at once, so a large job does not flood the database.
    """
    if mode not in ("append", "replace"):
        raise ValueError(f"mode {mode!r} is neither append nor replace")
    if mode == "replace" and df.isEmpty():
        return
    format, options = source
    (
        df.write.format(format)
        .options(**options, dbtable=table, batchsize=batch_size, numPartitions=connections, truncate=True)
        .mode("overwrite" if mode == "replace" else "append")
        .save()
    )


def merge_statement(table: str, stage: str, columns: Sequence[str], keys: Sequence[str], vendor: str = "ansi") -> str:
    """One set-based upsert from a staging table: an ANSI MERGE, or what MySQL has instead."""
    if vendor == "mysql":
        name = lambda c: f"`{c}`"
        listed = ", ".join(map(name, columns))
        changes = ", ".join(f"{name(c)} = VALUES({name(c)})" for c in columns if c not in keys)
        changes = changes or f"{name(keys[0])} = VALUES({name(keys[0])})"
        return f"INSERT INTO {table} ({listed}) SELECT {listed} FROM {stage} ON DUPLICATE KEY UPDATE {changes}"
    name = lambda c: f'"{c}"'
    on = " AND ".join(f"t.{name(k)} = s.{name(k)}" for k in keys)
    changes = ", ".join(f"{name(c)} = s.{name(c)}" for c in columns if c not in keys)
    update = f" WHEN MATCHED THEN UPDATE SET {changes}" if changes else ""
    listed = ", ".join(name(c) for c in columns)
    values = ", ".join(f"s.{name(c)}" for c in columns)
    return (
        f"MERGE INTO {table} t USING {stage} s ON {on}{update}"
        f" WHEN NOT MATCHED THEN INSERT ({listed}) VALUES ({values})"
    )


def upsert_table(
    df: DataFrame,
    source: tuple[str, Mapping[str, str]],
    table: str,
    merge_key: str | Sequence[str],
    run_statement: Callable[[str], None],
    stage_table: str,
    order_by: str | Sequence[str] | None = None,
    vendor: str = "ansi",
) -> None:
    """Upsert set-wise: all partitions write a staging table, then one MERGE runs.

    ``run_statement`` executes SQL text over the caller's own connection. A repeated key
    keeps the row greatest in ``order_by``, or fails without one.
    """
    keys = key_list(merge_key)
    if not keys:
        raise ValueError("an upsert needs a merge key")
    if df.isEmpty():
        return  # the stage may still hold an earlier delivery
    with discarding_stages(df.sparkSession):
        write_table(one_row_per_key(staged(df, "load"), keys, order_by), source, stage_table, "replace")
    run_statement(merge_statement(table, stage_table, df.columns, keys, vendor))
