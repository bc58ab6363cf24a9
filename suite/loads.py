"""Sources and sinks: what is written must read back as the table it came from."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import functions as F

from tablewright.scratch import scratch_folder
from tablewright.sources import (
    explode_path,
    extract,
    list_objects,
    load,
    read_pages,
    read_records,
    register_http,
    table_schema,
    write_records,
)
from tablewright.sources.http import HttpPost, HttpPostWriter

from .merges import CHANGES, changes
from .registry import new_database, query, source

PER_DOCUMENT = 10_000
CUSTOMER_SCHEMA = "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string"


@query("load_append", f"SELECT * FROM orders UNION ALL ({CHANGES})")
def load_append(spark, sf_dir):
    table = f"{new_database(spark)}.orders"
    orders = source(spark, sf_dir, "orders")
    load(orders, table)
    load(changes(orders), table, "append")
    return spark.table(table)


@query("load_replace", CHANGES)
def load_replace(spark, sf_dir):
    """Replaced by the changes; a later empty delivery leaves them in place."""
    table = f"{new_database(spark)}.orders"
    orders = source(spark, sf_dir, "orders")
    load(orders, table)
    load(changes(orders), table, "replace")
    load(orders.filter("o_orderdate > '2100-01-01'"), table, "replace")
    return spark.table(table)


@query(
    "load_upsert_last_wins",
    """
    WITH last AS (
        SELECT user_id, event_type, value, ts FROM
            (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS n FROM events) e
        WHERE n = 1
    )
    SELECT c_custkey AS user_id, coalesce(event_type, 'none') AS last_event, coalesce(value, 0) AS value
    FROM customer LEFT JOIN last ON c_custkey = user_id
    UNION ALL
    SELECT user_id, event_type, value FROM last WHERE user_id NOT IN (SELECT c_custkey FROM customer)
    """,
)
def load_upsert_last_wins(spark, sf_dir):
    """Every event upserts its user; the last one stands."""
    table = f"{new_database(spark)}.users"
    users = source(spark, sf_dir, "customer").selectExpr("c_custkey AS user_id", "'none' AS last_event", "0D AS value")
    load(users, table)
    events = source(spark, sf_dir, "events").selectExpr("user_id", "event_type AS last_event", "value", "ts", "event_id")
    load(events, table, "upsert", "user_id", ["ts", "event_id"])
    return spark.table(table)


@query("jsonl_roundtrip", "SELECT * FROM orders")
def jsonl_roundtrip(spark, sf_dir):
    orders = source(spark, sf_dir, "orders")
    path = scratch_folder(spark, "orders-jsonl")
    write_records(orders, path, "jsonl")
    return read_records(spark, path, "jsonl", schema=orders.schema)


@query("json_documents", "SELECT c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment FROM customer")
def json_documents(spark, sf_dir):
    """Files that are one JSON document each, an array of records."""
    path = scratch_folder(spark, "customer-json")
    pages = source(spark, sf_dir, "customer").withColumn("page", (F.col("c_custkey") / PER_DOCUMENT).cast("bigint"))
    arrays = pages.groupBy("page").agg(
        F.to_json(F.collect_list(F.struct("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"))).alias("value")
    )  # keys are unique, so at most PER_DOCUMENT records a page
    arrays.repartition("page").write.partitionBy("page").text(path)
    return read_records(spark, f"{path}/*", "json", schema=CUSTOMER_SCHEMA)


@query(
    "csv_all_strings",
    """
    SELECT CAST(c_custkey AS VARCHAR) AS c_custkey, c_name, CAST(c_acctbal AS VARCHAR) AS c_acctbal,
           CASE WHEN c_mktsegment = 'BUILDING' THEN '' ELSE c_mktsegment END AS c_mktsegment
    FROM customer
    """,
)
def csv_all_strings(spark, sf_dir):
    """Every column comes back as text, and an empty field as ''."""
    path = scratch_folder(spark, "customer-csv")
    segment = F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment"))
    customers = source(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_acctbal", segment.alias("c_mktsegment"))
    write_records(customers, path, "csv")
    return read_records(spark, path, "csv", multiline=False)


@query("csv_documents", "SELECT CAST(doc_id AS VARCHAR) AS doc_id, text, lang FROM documents")
def csv_documents(spark, sf_dir):
    """Whole texts with line breaks, quotes and commas survive the round trip."""
    path = scratch_folder(spark, "documents-csv")
    write_records(source(spark, sf_dir, "documents").select("doc_id", "text", "lang"), path, "csv")
    return read_records(spark, path, "csv")


@query(
    "response_path_explode",
    """
    SELECT event_id, event_type AS name FROM events
    UNION ALL SELECT event_id, 'k' || (props::JSON ->> 'k') FROM events
    """,
)
def response_path_explode(spark, sf_dir):
    """API answers that hide their records at data.items."""
    item = lambda name: F.struct("event_id", name.alias("name"))
    key = F.concat(F.lit("k"), F.get_json_object("props", "$.k"))
    items = F.array(item(F.col("event_type")), item(key))
    answer = F.to_json(F.struct(F.struct(items.alias("items")).alias("data")))
    answers = source(spark, sf_dir, "events").select(answer.alias("body"))
    return explode_path(answers, "body", "event_id: bigint, name: string", "data.items")


PER_PAGE = 250


@query(
    "paginated_source",
    f"SELECT s_suppkey, s_name, s_acctbal, CAST(s_suppkey // {PER_PAGE} + 1 AS INTEGER) AS page FROM supplier",
)
def paginated_source(spark, sf_dir):
    """Suppliers written out as numbered JSON pages and fetched page by page, in parallel."""
    path = scratch_folder(spark, "supplier-pages")
    suppliers = source(spark, sf_dir, "supplier").withColumn("page", (F.col("s_suppkey") / PER_PAGE).cast("int") + 1)
    record = F.struct("s_suppkey", "s_name", "s_acctbal")
    pages = suppliers.groupBy("page").agg(
        F.to_json(F.struct(F.struct(F.collect_list(record).alias("items")).alias("data"))).alias("value")
    )  # at most PER_PAGE records a page
    pages.repartition("page").write.partitionBy("page").text(path)
    last = suppliers.agg(F.max("page")).first()[0]
    records = read_pages(
        spark,
        f"{path}/page={{page}}",
        per_page=PER_PAGE,
        max_pages=last + 10,
        pages_per_task=max(1, last // 64),
        response_path="data.items",
    )
    typed = records.withColumn("r", F.from_json("record", "s_suppkey bigint, s_name string, s_acctbal double"))
    return typed.select("r.*", "page")


@query("list_objects", "SELECT event_type, TRUE AS listed FROM events GROUP BY event_type")
def list_objects_query(spark, sf_dir):
    """Files of a table written by event type, found again by walking its folder."""
    path = scratch_folder(spark, "event-files")
    source(spark, sf_dir, "events").write.partitionBy("event_type").parquet(path)
    files = list_objects(spark, path, "*.parquet").filter("length > 0")
    kind = F.regexp_extract("path", "event_type=([^/]+)", 1)
    return files.groupBy(kind.alias("event_type")).agg((F.count(F.lit(1)) > 0).alias("listed"))


@query(
    "parameterized_query",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' AND o_orderdate >= TIMESTAMP '1997-01-01'",
)
def parameterized_query(spark, sf_dir):
    source(spark, sf_dir, "orders").createOrReplaceTempView("orders_in")
    return extract(
        spark,
        "SELECT o_orderkey, o_totalprice FROM orders_in WHERE o_orderstatus = :status AND o_orderdate >= to_timestamp_ntz(:since)",
        {"status": "F", "since": "1997-01-01"},
    )


@query(
    "table_schema",
    "SELECT row_number() OVER ()::INTEGER AS ordinal_position, column_name FROM (DESCRIBE SELECT * FROM orders)",
)
def table_schema_query(spark, sf_dir):
    table = f"{new_database(spark)}.orders"
    load(source(spark, sf_dir, "orders"), table)
    return table_schema(spark, table).select("ordinal_position", "column_name")


class FolderWriter(HttpPostWriter):
    """Delivers what would be posted as files, so that it can be read back."""

    def deliver(self, payload: str) -> None:
        from pyarrow import fs

        files, path = fs.FileSystem.from_uri(self.url)
        files.create_dir(path, recursive=True)
        with files.open_output_stream(f"{path}/{uuid.uuid4().hex}.json") as out:
            out.write((json.dumps(json.loads(payload)) + "\n").encode("utf-8"))


class FolderPost(HttpPost):
    @classmethod
    def name(cls) -> str:
        return "folder_post"

    def writer(self, schema, overwrite: bool) -> FolderWriter:
        return FolderWriter(dict(self.options))


@query("post_sink", "SELECT s_suppkey, s_name, s_nationkey, s_acctbal FROM supplier")
def post_sink(spark, sf_dir):
    """Suppliers sent in batches; what was sent, read back."""
    register_http(spark, FolderPost)
    path = scratch_folder(spark, "posted")
    url = path if "://" in path else "file://" + path.removeprefix("file:")
    suppliers = source(spark, sf_dir, "supplier")
    suppliers.write.format("folder_post").options(url=url, batch="true", batch_size="1000").mode("append").save()
    return read_records(spark, path, "json", schema=suppliers.schema)


