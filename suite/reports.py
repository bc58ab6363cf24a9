"""Queries that read maintained tables, and the projections that feed them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablewright.operators import current_rows

from .dimensions import TWO_RUNS, two_runs
from .registry import new_database, query, source

# Sums of money go through exact decimals, so that no order of addition changes the result.
MONEY = "decimal(18,2)"


@query(
    "margin_join",
    """
    SELECT l_orderkey, l_linenumber, l_partkey, p_name, p_brand, l_extendedprice, p_retailprice,
           l_extendedprice - p_retailprice AS margin
    FROM lineitem JOIN part ON l_partkey = p_partkey
    """,
)
def margin_join(spark, sf_dir):
    lines, parts = source(spark, sf_dir, "lineitem"), source(spark, sf_dir, "part")
    return lines.join(parts, lines.l_partkey == parts.p_partkey).select(
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "p_name",
        "p_brand",
        "l_extendedprice",
        "p_retailprice",
        (F.col("l_extendedprice") - F.col("p_retailprice")).alias("margin"),
    )


@query(
    "fact_join",
    f"""
    SELECT o_orderkey, l_linenumber, o_custkey, o_orderdate, l_extendedprice, p_type AS category, d.c_mktsegment AS customer_tier
    FROM orders JOIN lineitem ON l_orderkey = o_orderkey
    JOIN part ON p_partkey = l_partkey
    JOIN ({TWO_RUNS}) d ON d.c_custkey = o_custkey AND d.is_current = TRUE
    """,
)
def fact_join(spark, sf_dir):
    """Order lines with product and the customer's current version."""
    orders = source(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = source(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    parts = source(spark, sf_dir, "part").select("p_partkey", F.col("p_type").alias("category"))
    customers = current_rows(two_runs(spark, sf_dir)).select("c_custkey", F.col("c_mktsegment").alias("customer_tier"))
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, F.col("l_partkey") == F.col("p_partkey"))
        .join(customers, F.col("o_custkey") == F.col("c_custkey"))
        .select("o_orderkey", "l_linenumber", "o_custkey", "o_orderdate", "l_extendedprice", "category", "customer_tier")
    )


@query(
    "daily_revenue",
    """
    SELECT CAST(o_orderdate AS DATE) AS date, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS revenue,
           count(*) AS orders
    FROM orders GROUP BY 1
    """,
)
def daily_revenue(spark, sf_dir):
    return (
        source(spark, sf_dir, "orders")
        .groupBy(F.to_date("o_orderdate").alias("date"))
        .agg(F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("revenue"), F.count(F.lit(1)).alias("orders"))
    )


@query(
    "customer_ltv",
    f"""
    SELECT c.c_custkey, c.c_name, c.c_mktsegment, c.c_nationkey, count(o_orderkey) AS total_orders,
           CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS lifetime_value, max(o_orderdate) AS last_order_at
    FROM ({TWO_RUNS}) c JOIN orders ON c.c_custkey = o_custkey
    WHERE c.is_current
    GROUP BY c.c_custkey, c.c_name, c.c_mktsegment, c.c_nationkey
    HAVING max(o_orderdate) > DATE '2001-08-01' - 90
    """,
)
def customer_ltv(spark, sf_dir):
    """Active customers: orders shrink to one row per customer before they meet the dimension.

    That equals grouping after the join because the current slice has one row per customer.
    """
    cutoff = F.date_sub(F.lit("2001-08-01").cast("date"), 90)
    activity = (
        source(spark, sf_dir, "orders")
        .groupBy("o_custkey")
        .agg(
            F.count("o_orderkey").alias("total_orders"),
            F.sum(F.col("o_totalprice").cast(MONEY)).cast("double").alias("lifetime_value"),
            F.max("o_orderdate").alias("last_order_at"),
        )
        .filter(F.col("last_order_at") > cutoff)
    )
    customers = current_rows(two_runs(spark, sf_dir)).select("c_custkey", "c_name", "c_mktsegment", "c_nationkey")
    return customers.join(activity, F.col("c_custkey") == F.col("o_custkey")).drop("o_custkey")


@query(
    "filter_project",
    "SELECT c_custkey AS account_id, c_name AS account_name, c_acctbal AS balance FROM customer WHERE c_acctbal >= 0",
)
def filter_project(spark, sf_dir):
    return (
        source(spark, sf_dir, "customer")
        .where("c_acctbal >= 0")
        .selectExpr("c_custkey AS account_id", "c_name AS account_name", "c_acctbal AS balance")
    )


@query(
    "grade_case",
    "SELECT c_custkey AS id, upper(c_name) AS name, CASE WHEN c_acctbal >= 5000 THEN 'A' ELSE 'B' END AS grade FROM customer",
)
def grade_case(spark, sf_dir):
    return source(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        F.upper("c_name").alias("name"),
        F.when(F.col("c_acctbal") >= 5000, "A").otherwise("B").alias("grade"),
    )


@query(
    "api_cleanup",
    """
    SELECT c_custkey AS user_id, lower(c_name) || '@example.com' AS email,
           CASE WHEN c_acctbal < 0 THEN 'Unknown' ELSE c_name END AS name,
           CASE WHEN c_mktsegment = 'BUILDING' THEN 'free' ELSE c_mktsegment END AS plan
    FROM customer
    """,
)
def api_cleanup(spark, sf_dir):
    """JSON users as an API delivers them, some without a name or a subscription."""
    api_user = F.struct(
        F.col("c_custkey").alias("id"),
        F.concat(F.upper("c_name"), F.lit("@Example.COM")).alias("email"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_name")).alias("name"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.struct(F.col("c_mktsegment").alias("plan"))).alias("subscription"),
    )
    delivered = source(spark, sf_dir, "customer").select(F.to_json(api_user).alias("body"))
    schema = "id bigint, email string, name string, subscription struct<plan: string>"
    return delivered.select(F.from_json("body", schema).alias("u")).select(
        F.col("u.id").alias("user_id"),
        F.lower("u.email").alias("email"),
        F.coalesce("u.name", F.lit("Unknown")).alias("name"),
        F.coalesce("u.subscription.plan", F.lit("free")).alias("plan"),
    )
