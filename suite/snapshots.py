"""Full refreshes, snapshots, appends and views."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablewright import AppendOnly, FullRefresh, Snapshot, View, materialize
from tablewright.operators import prune_snapshots, snapshot_rows, take_snapshot

from .registry import new_database, query, source

DAYS = [datetime(2026, 1, d) for d in (1, 2, 3, 4)]
BALANCES = "SELECT c_custkey AS account_id, c_name AS account_name, c_acctbal AS balance FROM customer"


def balances(spark, sf_dir):
    return source(spark, sf_dir, "customer").selectExpr("c_custkey AS account_id", "c_name AS account_name", "c_acctbal AS balance")


def stamped(day: int, rows: str = BALANCES) -> str:
    return f"SELECT *, TIMESTAMP '{DAYS[day]}' AS snapshot_at, 's{day}' AS snapshot_id FROM ({rows}) r{day}"


# Balances grow by one each day; overdrawn accounts leave the active set after the first.
def grown(day: int) -> str:
    return f"SELECT account_id, account_name, balance + {day} AS balance FROM ({BALANCES}) b WHERE balance >= 0"


@query("snapshot_append", f"{stamped(0)} UNION ALL {stamped(1, grown(1))}")
def snapshot_append(spark, sf_dir):
    accounts = balances(spark, sf_dir)
    first = snapshot_rows(accounts, DAYS[0], "s0")
    active = accounts.filter("balance >= 0").withColumn("balance", F.col("balance") + 1)
    return take_snapshot(first, active, DAYS[1], "s1")


PRUNED = f"{stamped(2, grown(2))} UNION ALL {stamped(3, grown(3))}"


@query("snapshot_prune", PRUNED)
def snapshot_prune(spark, sf_dir):
    accounts = balances(spark, sf_dir)
    kept = snapshot_rows(accounts, DAYS[0], "s0")
    for day in (1, 2, 3):
        active = accounts.filter("balance >= 0").withColumn("balance", F.col("balance") + day)
        kept = kept.unionByName(snapshot_rows(active, DAYS[day], f"s{day}"))
    return prune_snapshots(kept, "snapshot_at", 2)


@query("snapshot_table", PRUNED)
def snapshot_table(spark, sf_dir):
    """The same as a table partitioned by snapshot: pruning drops partitions unread."""
    table = f"{new_database(spark)}.balances"
    accounts = balances(spark, sf_dir)
    for day, at in enumerate(DAYS):
        active = accounts.filter("balance >= 0").withColumn("balance", F.col("balance") + day) if day else accounts
        config = Snapshot(target_table=table, source=active, retain_snapshots=2)
        materialize(spark, config, run_ts=at, snapshot_id=f"s{day}")
    return spark.table(table)


@query(
    "snapshot_dedupe",
    f"""
    SELECT event_id, ts, user_id, event_type, value, TIMESTAMP '{DAYS[0]}' AS snapshot_at, 's0' AS snapshot_id
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e WHERE n = 1
    """,
)
def snapshot_dedupe(spark, sf_dir):
    """One row per user in the snapshot: the latest event."""
    events = source(spark, sf_dir, "events").drop("props")
    return snapshot_rows(events, DAYS[0], "s0", keys="user_id", dedupe_order_by=["ts", "event_id"])


@query(
    "full_refresh",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_name, l_extendedprice, l_extendedprice - l_quantity * p_retailprice AS margin
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def full_refresh(spark, sf_dir):
    """The table is rebuilt over an older version of itself, with a hook before and after."""
    database = new_database(spark)
    table = f"{database}.margins"
    priced = source(spark, sf_dir, "lineitem").join(source(spark, sf_dir, "part"), F.col("l_partkey") == F.col("p_partkey"))
    margins = priced.select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "p_name",
        "l_extendedprice",
        (F.col("l_extendedprice") - F.col("l_quantity") * F.col("p_retailprice")).alias("margin"),
    )
    materialize(spark, FullRefresh(target_table=table, source=margins.withColumn("margin", F.lit(0.0))))
    materialize(
        spark,
        FullRefresh(
            target_table=table,
            source=margins,
            pre_hook=f"DROP VIEW IF EXISTS {database}.best",
            post_hook=f"CREATE VIEW {database}.best AS SELECT max(margin) AS margin FROM {table}",
        ),
    )
    return spark.table(table)


@query("append_only", "SELECT event_id, ts, event_type FROM events UNION ALL SELECT event_id, ts, event_type FROM events")
def append_only(spark, sf_dir):
    """The same delivery twice is kept twice."""
    table = f"{new_database(spark)}.log"
    config = AppendOnly(target_table=table, source=source(spark, sf_dir, "events").select("event_id", "ts", "event_type"))
    materialize(spark, config)
    materialize(spark, config)
    return spark.table(table)


@query(
    "view",
    """
    SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
    FROM orders GROUP BY o_orderpriority
    """,
)
def view(spark, sf_dir):
    database = new_database(spark)
    path = f"{sf_dir}/orders.parquet"
    materialize(
        spark,
        View(
            target_table=f"{database}.v_priorities",
            source=f"""
            SELECT o_orderpriority, count(*) AS orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue
            FROM parquet.`{path}` GROUP BY o_orderpriority
            """,
        ),
    )
    return spark.table(f"{database}.v_priorities")
