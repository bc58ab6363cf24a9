"""Incremental loads of orders, order lines and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import Incremental, materialize
from tablewright.operators import (
    append_rows,
    delete_insert,
    high_watermark,
    merge,
    newer_than,
    newer_than_target,
)
from tablewright.plans.buckets import BUCKET
from tablewright.sources import extract

from .registry import new_database, query, source

ORDER_COLUMNS = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"]

# Changes to orders: finished orders come in again under new keys (inserts), open ones are
# updated, pending ones are not mentioned.
CHANGES = """
    SELECT CASE WHEN o_orderstatus = 'F' THEN -1 - o_orderkey ELSE o_orderkey END AS o_orderkey,
           o_custkey, 'X' AS o_orderstatus, o_totalprice * 2 AS o_totalprice, o_orderdate, o_orderpriority
    FROM orders WHERE o_orderstatus <> 'P'
"""


def changes(orders):
    return orders.filter("o_orderstatus <> 'P'").select(
        F.when(F.col("o_orderstatus") == "F", -1 - F.col("o_orderkey")).otherwise(F.col("o_orderkey")).alias("o_orderkey"),
        "o_custkey",
        F.lit("X").alias("o_orderstatus"),
        (F.col("o_totalprice") * 2).alias("o_totalprice"),
        "o_orderdate",
        "o_orderpriority",
    )


def merge_sql(columns: dict[str, str], inserted: dict[str, str], with_changes: str = CHANGES) -> str:
    """Updated target rows, then inserted source rows."""
    updated = ", ".join(f"{e} AS {c}" for c, e in columns.items())
    added = ", ".join(f"{e} AS {c}" for c, e in inserted.items())
    return f"""
        WITH s AS ({with_changes})
        SELECT {updated} FROM orders t LEFT JOIN s ON t.o_orderkey = s.o_orderkey
        UNION ALL
        SELECT {added} FROM s WHERE NOT EXISTS (SELECT 1 FROM orders t WHERE t.o_orderkey = s.o_orderkey)
    """


def overwritten(*names: str) -> dict[str, str]:
    return {c: f"CASE WHEN s.o_orderkey IS NOT NULL THEN s.{c} ELSE t.{c} END" for c in names}


MERGED = merge_sql(
    {"o_orderkey": "t.o_orderkey", **overwritten(*ORDER_COLUMNS[1:])}, {c: f"s.{c}" for c in ORDER_COLUMNS}
)


@query("incremental_merge", MERGED)
def incremental_merge(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    return merge(orders, changes(orders), "o_orderkey")


@query(
    "incremental_delete_insert",
    """
    WITH s AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, -l_quantity AS l_quantity, l_extendedprice,
               l_discount, l_tax, 'N' AS l_returnflag, l_linestatus, l_shipdate
        FROM lineitem WHERE l_returnflag = 'R'
    )
    SELECT * FROM lineitem t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey)
    UNION ALL SELECT * FROM s
    """,
)
def incremental_delete_insert(spark, sf_dir):
    lines = source(spark, sf_dir, "lineitem")
    returned = lines.filter("l_returnflag = 'R'").withColumns(
        {"l_quantity": -F.col("l_quantity"), "l_returnflag": F.lit("N")}
    )
    return delete_insert(lines, returned, "l_orderkey")


@query(
    "incremental_append",
    """
    SELECT event_id, ts, user_id, event_type, value, props FROM events
    UNION ALL
    SELECT event_id, ts, user_id, 'refund', -value, props FROM events WHERE event_type = 'purchase'
    """,
)
def incremental_append(spark, sf_dir):
    events = source(spark, sf_dir, "events")
    refunds = events.filter("event_type = 'purchase'").withColumns(
        {"event_type": F.lit("refund"), "value": -F.col("value")}
    )
    return append_rows(events, refunds)


LATE_LINES = """
    SELECT l_orderkey, l_linenumber, l_partkey, l_shipdate FROM lineitem
    WHERE l_shipdate > (SELECT max(o_orderdate) FROM orders)
"""


@query("watermark_filter", LATE_LINES)
def watermark_filter(spark, sf_dir):
    mark = high_watermark(source(spark, sf_dir, "orders"), "o_orderdate")
    lines = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return newer_than(lines, "l_shipdate", mark)


KNOWN = "ts <= TIMESTAMP '2024-01-20' OR (event_type = 'error' AND ts <= TIMESTAMP '2024-01-22')"


@query(
    "stored_mark",
    f"SELECT event_id, ts, event_type FROM events WHERE {KNOWN} OR ts > (SELECT max(ts) FROM events WHERE {KNOWN})",
)
def stored_mark(spark, sf_dir):
    """A log that is appended to above its mark, which is kept with the files it covers; in between
    another job adds files of its own."""
    table = f"{new_database(spark)}.log"
    events = source(spark, sf_dir, "events").select("event_id", "ts", "event_type")
    until = lambda day: events.filter(F.col("ts") <= F.lit(day).cast("timestamp_ntz"))
    for day in ("2024-01-10", "2024-01-20"):
        materialize(spark, Incremental(target_table=table, source=until(day), incremental_column="ts"))
    errors = until("2024-01-22").filter("event_type = 'error' AND ts > TIMESTAMP_NTZ '2024-01-20'")
    errors.write.insertInto(table)
    materialize(spark, Incremental(target_table=table, source=events, incremental_column="ts"))
    return spark.table(table)


@query("watermark_subquery", LATE_LINES)
def watermark_subquery(spark, sf_dir):
    shipped = source(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("l_shipdate"))
    lines = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_shipdate")
    return newer_than_target(lines, shipped, "l_shipdate")


@query(
    "self_watermark_source",
    """
    SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM lineitem
    WHERE l_shipdate > coalesce((SELECT max(o_orderdate) FROM orders), TIMESTAMP '1970-01-01')
    """,
)
def self_watermark_source(spark, sf_dir):
    """A source whose own SQL asks the target how far it got."""
    source(spark, sf_dir, "lineitem").createOrReplaceTempView("incoming_lines")
    source(spark, sf_dir, "orders").createOrReplaceTempView("loaded_orders")
    return extract(
        spark,
        """
        SELECT l_orderkey, l_linenumber, l_quantity, l_shipdate FROM incoming_lines
        WHERE l_shipdate > coalesce((SELECT max(o_orderdate) FROM loaded_orders), to_timestamp_ntz(:start))
        """,
        {"start": "1970-01-01"},
    )


@query(
    "incremental_table",
    """
    SELECT o_orderkey, o_custkey,
           CASE WHEN o_orderdate > (SELECT max(o_orderdate) FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')
                THEN 'X' ELSE o_orderstatus END AS o_orderstatus,
           o_totalprice, o_orderdate, o_orderpriority
    FROM orders
    """,
)
def incremental_table(spark, sf_dir):
    """First load of the early orders, then a merge of all that lies above the mark."""
    orders = source(spark, sf_dir, "orders")
    table = f"{new_database(spark)}.orders"
    for delivered in (orders.filter("o_orderdate < '1998-01-01'"), orders.withColumn("o_orderstatus", F.lit("X"))):
        materialize(
            spark,
            Incremental(target_table=table, source=delivered, unique_key="o_orderkey", incremental_column="o_orderdate"),
        )
    return spark.table(table)


@query("incremental_merge_table", MERGED)
def incremental_merge_table(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    table = f"{new_database(spark)}.orders"
    for delivered in (orders, changes(orders)):
        materialize(spark, Incremental(target_table=table, source=delivered, unique_key="o_orderkey"))
    return spark.table(table)


BUCKETS = 16


@query("incremental_merge_bucketed", MERGED)
def incremental_merge_bucketed(spark, sf_dir):
    """The merge on a table laid out by a hash of its key."""
    orders = source(spark, sf_dir, "orders")
    table = f"{new_database(spark)}.orders"
    for delivered in (orders, changes(orders)):
        materialize(spark, Incremental(target_table=table, source=delivered, unique_key="o_orderkey", buckets=BUCKETS))
    return spark.table(table).drop(BUCKET)


REPLACED_LINES = """
    WITH s AS (
        SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, -l_quantity AS l_quantity, l_extendedprice,
               l_discount, l_tax, 'N' AS l_returnflag, l_linestatus, l_shipdate
        FROM lineitem WHERE l_orderkey % 1000 = 7
    )
    SELECT * FROM lineitem t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.l_orderkey = t.l_orderkey)
    UNION ALL SELECT * FROM s
"""


@query("delete_insert_bucketed", REPLACED_LINES)
def delete_insert_bucketed(spark, sf_dir):
    """Orders delivered anew replace all of their lines, bucket by bucket."""
    lines = source(spark, sf_dir, "lineitem")
    anew = lines.filter("l_orderkey % 1000 = 7").withColumns({"l_quantity": -F.col("l_quantity"), "l_returnflag": F.lit("N")})
    table = f"{new_database(spark)}.lines"
    for delivered in (lines, anew):
        config = Incremental(
            target_table=table, source=delivered, unique_key="l_orderkey", incremental_strategy="delete+insert", buckets=BUCKETS
        )
        materialize(spark, config)
    return spark.table(table).drop(BUCKET)


# The source lacks o_orderpriority and brings a new column.
RESHAPED = f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, 'web' AS channel FROM ({CHANGES}) c"
SHARED = ORDER_COLUMNS[1:-1]


def reshaped(orders):
    return changes(orders).drop("o_orderpriority").withColumn("channel", F.lit("web"))


def schema_sql(kept: bool, added: bool) -> str:
    updated = {"o_orderkey": "t.o_orderkey", **overwritten(*SHARED)}
    inserted = {c: f"s.{c}" for c in ORDER_COLUMNS[:-1]}
    if kept:
        updated["o_orderpriority"], inserted["o_orderpriority"] = "t.o_orderpriority", "NULL"
    if added:
        updated["channel"], inserted["channel"] = "s.channel", "s.channel"
    return merge_sql(updated, inserted, RESHAPED)


@query("schema_ignore", schema_sql(kept=True, added=False))
def schema_ignore(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    return merge(orders, reshaped(orders), "o_orderkey", on_schema_change="ignore")


@query("schema_append_new", schema_sql(kept=True, added=True))
def schema_append_new(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    return merge(orders, reshaped(orders), "o_orderkey", on_schema_change="append_new_columns")


@query("schema_sync_all", schema_sql(kept=False, added=True))
def schema_sync_all(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    return merge(orders, reshaped(orders), "o_orderkey", on_schema_change="sync_all_columns")
