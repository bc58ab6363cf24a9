"""Changes of columns, formats and modes on tables that exist."""

from __future__ import annotations

from pyspark.sql import functions as F

from tablewright import Incremental, materialize
from tablewright.plans.steps import StepLog
from tablewright.scratch import scratch_folder
from tablewright.sources import explode_path, load
from tablewright.streaming import append_stream

from .registry import new_database, query, source
from .streams import event_stream, finished

ACCOUNTS = "SELECT c_custkey AS account, c_acctbal AS balance, c_mktsegment AS segment FROM customer"
#: Overdrawn accounts come again under a new column, with a thousand added.
RAISED = "SELECT account, balance + 1000 AS balance, segment, 'overdrawn' AS note FROM a WHERE balance < 0"


def accounts(spark, sf_dir):
    return source(spark, sf_dir, "customer").selectExpr("c_custkey AS account", "c_acctbal AS balance", "c_mktsegment AS segment")


def raised(df):
    return df.filter("balance < 0").selectExpr("account", "balance + 1000 AS balance", "segment", "'overdrawn' AS note")


def by_segment(spark, sf_dir, provider="parquet"):
    table = f"{new_database(spark)}.accounts"
    accounts(spark, sf_dir).write.format(provider).partitionBy("segment").saveAsTable(table)
    return table


@query(
    "schema_append_new_partitioned",
    f"WITH a AS ({ACCOUNTS}), s AS ({RAISED}) SELECT account, balance, segment, NULL AS note FROM a WHERE balance >= 0 UNION ALL SELECT * FROM s",
)
def schema_append_new_partitioned(spark, sf_dir):
    """A merge brings a new column to a table partitioned by segment."""
    table = by_segment(spark, sf_dir)
    materialize(spark, Incremental(target_table=table, source=raised(accounts(spark, sf_dir)), unique_key="account"))
    return spark.table(table)


@query(
    "schema_sync_all_partitioned",
    f"WITH a AS ({ACCOUNTS}), s AS ({RAISED}) SELECT account, segment, NULL AS note FROM a WHERE balance >= 0 UNION ALL SELECT account, segment, note FROM s",
)
def schema_sync_all_partitioned(spark, sf_dir):
    """The same, and the balance goes, which the delivery lacks."""
    table = by_segment(spark, sf_dir)
    delivered = raised(accounts(spark, sf_dir)).drop("balance")
    config = Incremental(target_table=table, source=delivered, unique_key="account", on_schema_change="sync_all_columns")
    materialize(spark, config)
    return spark.table(table)


@query("merge_orc", f"WITH a AS ({ACCOUNTS}) SELECT account, CASE WHEN balance < 0 THEN balance + 1000 ELSE balance END AS balance, segment FROM a")
def merge_orc(spark, sf_dir):
    """A merge into an ORC table leaves it one."""
    table = f"{new_database(spark)}.accounts"
    accounts(spark, sf_dir).write.format("orc").saveAsTable(table)
    delivered = raised(accounts(spark, sf_dir)).drop("note")
    materialize(spark, Incremental(target_table=table, source=delivered, unique_key="account"))
    return spark.table(table)


@query("load_replace_partitioned", f"WITH a AS ({ACCOUNTS}) SELECT account, NULL AS balance, segment FROM a WHERE balance < 0")
def load_replace_partitioned(spark, sf_dir):
    """All rows replaced by a delivery that lacks a column."""
    table = by_segment(spark, sf_dir)
    load(accounts(spark, sf_dir).filter("balance < 0").drop("balance"), table, "replace")
    return spark.table(table)


@query("load_upsert_partitioned", f"WITH a AS ({ACCOUNTS}) SELECT account, CASE WHEN balance < 0 THEN balance + 1000 ELSE balance END AS balance, segment FROM a")
def load_upsert_partitioned(spark, sf_dir):
    table = by_segment(spark, sf_dir)
    load(raised(accounts(spark, sf_dir)).drop("note"), table, "upsert", merge_key="account")
    return spark.table(table)


@query("stream_append_existing", "SELECT event_id, user_id, event_type FROM events")
def stream_append_existing(spark, sf_dir):
    """Rows in the table, rows from a stream, and rows appended after it are all there."""
    table = f"{new_database(spark)}.log"
    columns = ["event_id", "user_id", "event_type"]
    events = source(spark, sf_dir, "events").select(*columns)
    events.filter("event_type = 'error'").write.saveAsTable(table)
    stream = event_stream(spark, sf_dir).select(*columns).filter("event_type NOT IN ('error', 'signup')")
    finished(append_stream(stream, table, scratch_folder(spark, "append-existing")))
    load(events.filter("event_type = 'signup'"), table)
    return spark.table(table)


@query("response_path_object", "SELECT event_id, event_type AS name FROM events")
def response_path_object(spark, sf_dir):
    """API answers with one record, or a list of one, at data.item."""
    record = F.struct("event_id", F.col("event_type").alias("name"))
    answer = lambda item: F.to_json(F.struct(F.struct(item.alias("item")).alias("data")))
    body = F.when(F.col("event_id") % 2 == 0, answer(record)).otherwise(answer(F.array(record)))
    answers = source(spark, sf_dir, "events").select(body.alias("body"))
    return explode_path(answers, "body", "event_id: bigint, name: string", "data.item")


@query(
    "step_log",
    """
    SELECT 'big' AS name, 'success' AS status, (SELECT count(*) FROM orders) AS rows_in, (SELECT count(*) FROM orders WHERE o_totalprice > 100000) AS rows_out
    UNION ALL SELECT 'broken', 'failed', NULL, NULL
    """,
)
def step_log(spark, sf_dir):
    """Steps that count what they read and write while it flows by, one of which fails."""
    log, table = StepLog("orders", "run-1"), f"{new_database(spark)}.big"
    with log.step("big") as step:
        orders = step.reading(source(spark, sf_dir, "orders"))
        step.writing(orders.filter("o_totalprice > 100000")).write.saveAsTable(table)
    try:
        with log.step("broken"):
            raise ValueError("no such file")
    except ValueError:
        pass
    return log.frame(spark).select("name", "status", "rows_in", "rows_out")
