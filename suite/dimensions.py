"""Customer dimension, overwritten and versioned."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablewright import Scd1, Scd2, materialize
from tablewright.functions import row_hash
from tablewright.operators import as_of, current_rows, scd1, scd1_initial, scd2, scd2_initial
from tablewright.operators.dimensions import join_as_of, join_as_of_binned, version_changes
from tablewright.plans.buckets import BUCKET

from .registry import new_database, query, source

T0, T1, T2 = datetime(1995, 1, 1), datetime(1998, 1, 1), datetime(2000, 1, 1)
COLUMNS = ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"]
TRACKED = ["c_mktsegment", "c_nationkey"]

# A later extract: customers outside one region, overdrawn ones in a new segment, an
# untracked balance that always differs, and suppliers as new members.
EXTRACT = """
    SELECT c_custkey, c_name, c_nationkey, c_acctbal + 1 AS c_acctbal,
           CASE WHEN c_acctbal < 0 THEN 'AT_RISK' ELSE c_mktsegment END AS c_mktsegment
    FROM customer JOIN nation ON c_nationkey = n_nationkey WHERE n_regionkey <> 0
    UNION ALL
    SELECT -1 - s_suppkey, s_name, s_nationkey, s_acctbal, 'SUPPLIER' FROM supplier
"""


def later_extract(spark, sf_dir):
    nation = source(spark, sf_dir, "nation").filter("n_regionkey <> 0")
    customers = (
        source(spark, sf_dir, "customer")
        .join(nation, F.col("c_nationkey") == F.col("n_nationkey"))
        .select(
            "c_custkey",
            "c_name",
            "c_nationkey",
            (F.col("c_acctbal") + 1).alias("c_acctbal"),
            F.when(F.col("c_acctbal") < 0, "AT_RISK").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"),
        )
    )
    suppliers = source(spark, sf_dir, "supplier").select(
        (-1 - F.col("s_suppkey")).alias("c_custkey"),
        F.col("s_name").alias("c_name"),
        F.col("s_nationkey").alias("c_nationkey"),
        F.col("s_acctbal").alias("c_acctbal"),
        F.lit("SUPPLIER").alias("c_mktsegment"),
    )
    return customers.unionByName(suppliers)


def scd1_sql(tracked: list[str]) -> str:
    differs = " OR ".join(f"t.{c} IS DISTINCT FROM s.{c}" for c in tracked) or "TRUE"
    touched = f"s.c_custkey IS NOT NULL AND ({differs})"
    updated = ", ".join(f"CASE WHEN {touched} THEN s.{c} ELSE t.{c} END AS {c}" for c in COLUMNS[1:])
    return f"""
        WITH s AS ({EXTRACT})
        SELECT t.c_custkey, {updated},
               CASE WHEN {touched} THEN TIMESTAMP '{T1}' ELSE TIMESTAMP '{T0}' END AS updated_at
        FROM customer t LEFT JOIN s ON t.c_custkey = s.c_custkey
        UNION ALL
        SELECT s.c_custkey, s.c_name, s.c_nationkey, s.c_acctbal, s.c_mktsegment, TIMESTAMP '{T1}'
        FROM s WHERE NOT EXISTS (SELECT 1 FROM customer t WHERE t.c_custkey = s.c_custkey)
    """


@query("scd1", scd1_sql(TRACKED))
def scd1_query(spark, sf_dir):
    first = scd1_initial(source(spark, sf_dir, "customer"), T0)
    return scd1(first, later_extract(spark, sf_dir), "c_custkey", TRACKED, T1)


@query("scd1_touch_all", scd1_sql([]))
def scd1_touch_all(spark, sf_dir):
    first = scd1_initial(source(spark, sf_dir, "customer"), T0)
    return scd1(first, later_extract(spark, sf_dir), "c_custkey", [], T1)


@query("scd1_table", scd1_sql(TRACKED))
def scd1_table(spark, sf_dir):
    table = f"{new_database(spark)}.customers"
    for delivered, at in ((source(spark, sf_dir, "customer"), T0), (later_extract(spark, sf_dir), T1)):
        config = Scd1(target_table=table, source=delivered, unique_key="c_custkey", tracked_columns=TRACKED)
        materialize(spark, config, run_ts=at)
    return spark.table(table)


@query("scd1_bucketed", scd1_sql(TRACKED))
def scd1_bucketed(spark, sf_dir):
    table = f"{new_database(spark)}.customers"
    for delivered, at in ((source(spark, sf_dir, "customer"), T0), (later_extract(spark, sf_dir), T1)):
        config = Scd1(target_table=table, source=delivered, unique_key="c_custkey", tracked_columns=TRACKED, buckets=16)
        materialize(spark, config, run_ts=at)
    return spark.table(table).drop(BUCKET)


HASH = "md5(" + " || '|' || ".join(f"coalesce(CAST(r.{c} AS VARCHAR), '')" for c in TRACKED) + ")"


def first_version(rows: str) -> str:
    return f"""SELECT *, TIMESTAMP '{T0}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current,
               {HASH} AS row_hash FROM ({rows}) r"""


def next_version(state: str, rows: str, at: datetime, close_missing: bool = True) -> str:
    """SQL for one run over a state, both given as SQL."""
    gone = "s.c_custkey IS NULL" if close_missing else "FALSE"
    return f"""
        SELECT t.* EXCLUDE (valid_to, is_current),
               CASE WHEN t.is_current AND ({gone} OR s.new_hash <> t.row_hash) THEN TIMESTAMP '{at}' ELSE t.valid_to END AS valid_to,
               t.is_current AND NOT coalesce({gone} OR s.new_hash <> t.row_hash, FALSE) AS is_current
        FROM ({state}) t LEFT JOIN (SELECT *, {HASH} AS new_hash FROM ({rows}) r) s ON t.c_custkey = s.c_custkey
        UNION ALL BY NAME
        SELECT r.*, TIMESTAMP '{at}' AS valid_from, CAST(NULL AS TIMESTAMP) AS valid_to, TRUE AS is_current, {HASH} AS row_hash
        FROM ({rows}) r
        WHERE NOT EXISTS (SELECT 1 FROM ({state}) t WHERE t.is_current AND t.c_custkey = r.c_custkey AND t.row_hash = {HASH})
    """


CUSTOMERS = "SELECT * FROM customer"
BUYERS = "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '2001-01-01')"
TWO_RUNS = next_version(first_version(CUSTOMERS), EXTRACT, T1)


def two_runs(spark, sf_dir, **options):
    first = scd2_initial(source(spark, sf_dir, "customer"), "c_custkey", TRACKED, T0)
    return scd2(first, later_extract(spark, sf_dir), "c_custkey", TRACKED, T1, **options)


@query("scd2", TWO_RUNS)
def scd2_query(spark, sf_dir):
    return two_runs(spark, sf_dir)


@query("scd2_keep_missing", next_version(first_version(CUSTOMERS), EXTRACT, T1, close_missing=False))
def scd2_keep_missing(spark, sf_dir):
    return two_runs(spark, sf_dir, close_missing=False)


@query("scd2_hard_delete", next_version(first_version(CUSTOMERS), BUYERS, T1))
def scd2_hard_delete(spark, sf_dir):
    """Customers without a recent order leave the extract and are closed."""
    customers = source(spark, sf_dir, "customer")
    recent = source(spark, sf_dir, "orders").filter("o_orderdate >= '2001-01-01'")
    buyers = customers.join(recent, customers.c_custkey == recent.o_custkey, "left_semi")
    first = scd2_initial(customers, "c_custkey", TRACKED, T0)
    return scd2(first, buyers, "c_custkey", TRACKED, T1)


THREE_RUNS = next_version(TWO_RUNS, CUSTOMERS, T2)


@query("scd2_reappear", THREE_RUNS)
def scd2_reappear(spark, sf_dir):
    """A third run brings the first extract back: deleted keys return, changed ones revert."""
    return scd2(two_runs(spark, sf_dir), source(spark, sf_dir, "customer"), "c_custkey", TRACKED, T2)


@query("scd2_table", THREE_RUNS)
def scd2_table(spark, sf_dir):
    table = f"{new_database(spark)}.customers"
    customers = source(spark, sf_dir, "customer")
    for delivered, at in ((customers, T0), (later_extract(spark, sf_dir), T1), (customers, T2)):
        config = Scd2(target_table=table, source=delivered, unique_key="c_custkey", tracked_columns=TRACKED)
        materialize(spark, config, run_ts=at)
    return spark.table(table)


@query("scd2_current", f"SELECT * FROM ({TWO_RUNS}) d WHERE is_current")
def scd2_current(spark, sf_dir):
    return current_rows(two_runs(spark, sf_dir))


AS_OF = "1997-06-30"


@query(
    "scd2_as_of",
    f"""SELECT * FROM ({TWO_RUNS}) d WHERE valid_from <= TIMESTAMP '{AS_OF}'
        AND (valid_to IS NULL OR valid_to > TIMESTAMP '{AS_OF}')""",
)
def scd2_as_of(spark, sf_dir):
    return as_of(two_runs(spark, sf_dir), AS_OF)


JOINED_AS_OF = f"""
    SELECT o.*, d.c_mktsegment, d.valid_from FROM orders o LEFT JOIN ({TWO_RUNS}) d
    ON o.o_custkey = d.c_custkey AND d.valid_from <= o.o_orderdate
    AND (d.valid_to IS NULL OR d.valid_to > o.o_orderdate)
"""


@query("scd2_join_as_of", JOINED_AS_OF)
def scd2_join_as_of(spark, sf_dir):
    """Each order with the customer version valid on its date."""
    dimension = two_runs(spark, sf_dir).select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "valid_from", "valid_to"
    )
    return join_as_of(source(spark, sf_dir, "orders"), dimension, "o_custkey", "o_orderdate").drop("valid_to")


@query("scd2_join_as_of_binned", JOINED_AS_OF)
def scd2_join_as_of_binned(spark, sf_dir):
    """The same by bins of time, for keys with many versions."""
    dimension = two_runs(spark, sf_dir).select(
        F.col("c_custkey").alias("o_custkey"), "c_mktsegment", "valid_from", "valid_to"
    )
    return join_as_of_binned(source(spark, sf_dir, "orders"), dimension, "o_custkey", "o_orderdate").drop("valid_to")


@query(
    "price_versions",
    """
    WITH day AS (
        SELECT o_custkey % 3 AS shelf, o_orderkey, o_totalprice AS price, o_orderdate AS valid_from
        FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey % 3, o_orderdate ORDER BY o_orderkey) = 1
    ), v AS (
        SELECT *, lead(valid_from) OVER (PARTITION BY shelf ORDER BY valid_from) AS valid_to FROM day
    )
    SELECT l.l_orderkey, l.l_linenumber, l.l_shipdate, v.o_orderkey AS set_by, v.price
    FROM lineitem l LEFT JOIN v ON v.shelf = l.l_partkey % 3 AND v.valid_from <= l.l_shipdate
        AND (v.valid_to IS NULL OR v.valid_to > l.l_shipdate)
    """,
)
def price_versions(spark, sf_dir):
    """Three keys with a version for every day of orders; each line takes the one valid when it was shipped."""
    orders = source(spark, sf_dir, "orders").select((F.col("o_custkey") % 3).alias("shelf"), "o_orderkey", "o_totalprice", "o_orderdate")
    first = orders.groupBy("shelf", "o_orderdate").agg(F.min(F.struct("o_orderkey", "o_totalprice")).alias("set"))
    until = F.expr("lead(o_orderdate) over (partition by shelf order by o_orderdate)")
    versions = first.select("shelf", F.col("set.o_orderkey").alias("set_by"), F.col("set.o_totalprice").alias("price"), F.col("o_orderdate").alias("valid_from"), until.alias("valid_to"))
    lines = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_shipdate", (F.col("l_partkey") % 3).alias("shelf"))
    return join_as_of_binned(lines, versions, "shelf", "l_shipdate").drop("shelf", "valid_from", "valid_to")


@query(
    "scd2_history",
    f"""WITH d AS ({TWO_RUNS})
        SELECT n.c_custkey, n.valid_from, n.valid_to, n.c_mktsegment, p.c_mktsegment AS previous_c_mktsegment
        FROM d n LEFT JOIN d p ON p.c_custkey = n.c_custkey AND p.valid_to = n.valid_from
        ORDER BY n.c_custkey, n.valid_from""",
)
def scd2_history(spark, sf_dir):
    """Every version with what it changed from."""
    return version_changes(two_runs(spark, sf_dir), "c_custkey", ["c_mktsegment"]).orderBy("c_custkey", "valid_from")


@query(
    "row_hash",
    """
    SELECT o_orderkey, md5(coalesce(o_orderstatus, '') || '|' || coalesce(o_orderpriority, '') || '|' ||
               coalesce(CAST(o_custkey AS VARCHAR), '') || '|' || coalesce(CAST(o_orderdate AS VARCHAR), '')) AS row_hash
    FROM orders
    """,
)
def row_hash_query(spark, sf_dir):
    return source(spark, sf_dir, "orders").select(
        "o_orderkey", row_hash(["o_orderstatus", "o_orderpriority", "o_custkey", "o_orderdate"]).alias("row_hash")
    )
