"""A small brokerage warehouse kept over two days: catalogue, clients, bookings, a day book."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tablewright import FullRefresh, Incremental, Scd2, View, materialize

from .registry import new_database, query, source

MONEY = "decimal(18,2)"
SPLIT = "1999-01-01"
DAYS = (datetime(2026, 1, 1), datetime(2026, 1, 2))


def day_book(spark, database: str, articles, clients, bookings, day: datetime):
    """One day's run: replace the catalogue, version the clients, book what is newer."""
    at = lambda name: f"{database}.{name}"
    materialize(spark, FullRefresh(target_table=at("catalogue"), source=articles), run_ts=day)
    versions = Scd2(target_table=at("clients"), source=clients, unique_key="client", tracked_columns=["segment"])
    materialize(spark, versions, run_ts=day)
    segments = spark.table(at("clients")).filter("is_current").select("client", "segment")
    brands = spark.table(at("catalogue")).select("article", "brand")
    booked = bookings.join(segments, "client").join(brands, "article")
    facts = Incremental(target_table=at("bookings"), source=booked, unique_key="booking", incremental_column="booked_at")
    materialize(spark, facts, run_ts=day)
    text = f"SELECT CAST(booked_at AS DATE) AS date, sum(amount) AS revenue, count(*) AS orders FROM {at('bookings')} GROUP BY ALL"
    materialize(spark, View(target_table=at("day_book"), source=text))


@query(
    "warehouse_etl",
    f"""
    SELECT CAST(o_orderdate AS DATE) AS date,
           CAST(sum(CAST(CASE WHEN o_orderdate >= TIMESTAMP '{SPLIT}' THEN o_totalprice * 2 ELSE o_totalprice END AS DECIMAL(18, 2))) AS DOUBLE) AS revenue,
           count(*) AS orders
    FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem) GROUP BY 1
    """,
)
def warehouse_etl(spark, sf_dir):
    """Two days, read through the day book.

    The first day books orders up to a date; the second delivers all of them with doubled
    amounts, of which the high-water mark admits the newer ones.
    """
    articles = source(spark, sf_dir, "part").selectExpr("p_partkey AS article", "p_brand AS brand")
    clients = source(spark, sf_dir, "customer").selectExpr("c_custkey AS client", "c_mktsegment AS segment")
    lines = source(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.min("l_partkey").alias("article"))
    orders = source(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    bookings = orders.select(
        F.col("o_orderkey").alias("booking"),
        F.col("o_custkey").alias("client"),
        "article",
        F.col("o_totalprice").cast(MONEY).alias("amount"),
        F.col("o_orderdate").alias("booked_at"),
    )
    database = new_database(spark)
    day_book(spark, database, articles, clients, bookings.filter(F.col("booked_at") < SPLIT), DAYS[0])
    later = bookings.withColumn("amount", (F.col("amount") * 2).cast(MONEY))
    day_book(spark, database, articles, clients.withColumn("segment", F.lower("segment")), later, DAYS[1])
    return spark.table(f"{database}.day_book").withColumn("revenue", F.col("revenue").cast("double"))
