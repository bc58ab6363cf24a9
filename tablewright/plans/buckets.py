"""Tables laid out by a hash of their key, so that a change rewrites few of their files.

A keyed table without a natural partition can be partitioned by a *bucket*, a hash of the key modulo a number
that is fixed when the table is made and kept as a table property. Which buckets a delivery touches follows
from its keys alone: the target is neither scanned for them nor are other buckets read or written. A
row never changes its bucket. Rows without a full key match nothing; they lie in a partition of their own,
which is only appended to.

With n buckets, a delivery of k keys rewrites at most min(k, n) / n of the table. Buckets should hold a
few files' worth each: the number of buckets is the table's size over some hundred megabytes.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import assigned, column, has_key
from ..operators.schema import conform
from ..scratch import staged
from . import commit

BUCKET = "key_bucket"
PROPERTY = "tablewright.buckets"
MOST = 100_000


def bucket_of(keys: Sequence[str], buckets: int) -> Column:
    """The bucket of a row; NULL without a full key."""
    number = F.pmod(F.xxhash64(*[column(k) for k in keys]), F.lit(buckets)).cast("int")
    return F.when(has_key(keys), number)


def with_bucket(df: DataFrame, keys: Sequence[str], buckets: int) -> DataFrame:
    if not 0 < buckets <= MOST:
        raise ValueError(f"a table has 1 to {MOST} buckets, not {buckets}")
    if BUCKET in df.columns:
        raise ValueError(f"the source has a column {BUCKET} of its own")
    return df.withColumn(BUCKET, bucket_of(keys, buckets))


def buckets_of(spark: SparkSession, name: str) -> int:
    """How many buckets the table was made with; 0 if it has none."""
    rows = spark.sql(f"SHOW TBLPROPERTIES {commit.table_name(name)}").collect()  # one row per property
    return int({r["key"]: r["value"] for r in rows}.get(PROPERTY, 0))


def mark(spark: SparkSession, name: str, buckets: int) -> None:
    spark.sql(f"ALTER TABLE {commit.table_name(name)} SET TBLPROPERTIES ('{PROPERTY}' = '{buckets}')")


def change(
    name: str,
    target: DataFrame,
    source: DataFrame,
    keys: Sequence[str],
    transition: Callable[[DataFrame, DataFrame], DataFrame],
) -> int:
    """Replace the touched buckets of the table ``name`` by ``transition`` of their rows and the source's.

    ``target`` is the table, with columns it is about to get. Returns how many buckets were
    replaced.
    """
    spark = source.sparkSession
    types = {f.name: f.dataType for f in target.schema.fields}
    given = {f.name: f.dataType for f in source.schema.fields}
    # the hash is of the key as the table holds it
    typed = source.withColumns({k: assigned(column(k), given[k], types[k], k) for k in keys})
    delivered = staged(with_bucket(typed, keys, buckets_of(spark, name)), "source")
    touched = [r[0] for r in delivered.select(BUCKET).distinct().collect()]  # at most one per bucket
    numbers = [b for b in touched if b is not None]
    commit.add_columns(spark, target, name)
    if numbers:
        scope = commit.in_partitions(target, BUCKET, numbers)
        commit.replace_partitions(transition(scope, delivered.filter(has_key(keys))), name)
    if len(numbers) < len(touched):
        fresh = transition(target.limit(0), delivered.filter(~has_key(keys)))
        commit.append(conform(fresh, target), name)
    return len(numbers)
