"""Writing a table's next state with plain Spark tables.

Built-in file formats have no MERGE, UPDATE or DELETE, so a state is committed in one of
three ways, cheapest first: append files, replace the touched partitions, or write a new
version next to the old one and point the table at it.
"""

from __future__ import annotations

import threading
import uuid
from collections.abc import Sequence
from contextlib import contextmanager
from urllib.parse import unquote

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.columns import column, field, quoted
from ..scratch import remove_folder, staged
from . import journal

_NULL_PARTITION = "__HIVE_DEFAULT_PARTITION__"
_VERSION = "__v-"


def table_name(name: str) -> str:
    return ".".join(quoted(part) for part in name.split("."))


def table_exists(spark: SparkSession, name: str) -> bool:
    return spark.catalog.tableExists(name)


def row_count(spark: SparkSession, name: str) -> int:
    """Answered from file footers, without reading data."""
    return spark.table(table_name(name)).count()


def described(spark: SparkSession, name: str) -> tuple[list[str], dict[str, str]]:
    """(partition columns, details such as Location and Provider) from one DESCRIBE."""
    partitions, details, section = [], {}, ""
    for row in spark.sql(f"DESCRIBE TABLE EXTENDED {table_name(name)}").collect():  # one row per column
        if row.col_name.startswith("# ") and row.col_name != "# col_name":
            section = row.col_name
        elif section == "# Partition Information" and row.col_name not in ("", "# col_name"):
            partitions.append(row.col_name)
        elif section == "# Detailed Table Information":
            details[row.col_name] = row.data_type
    return partitions, details


def partition_columns(spark: SparkSession, name: str) -> list[str]:
    return described(spark, name)[0]


def laid_out(df: DataFrame, partition_by: Sequence[str], cluster_by: Sequence[str] = ()) -> DataFrame:
    """Rows of a partition together, in files of even size, sorted by the cluster columns.

    ``rebalance`` lets adaptive execution split a partition value that holds much of the
    table over several tasks and join small ones, which ``repartition`` would not.
    """
    if partition_by:
        df = df.hint("rebalance", *[column(c) for c in partition_by])
    if partition_by or cluster_by:
        df = df.sortWithinPartitions(*[column(c) for c in (*partition_by, *cluster_by)])
    return df


def create(
    df: DataFrame,
    name: str,
    partition_by: Sequence[str] = (),
    cluster_by: Sequence[str] = (),
    provider: str = "parquet",
    path: str | None = None,
) -> None:
    writer = laid_out(df, partition_by, cluster_by).write.format(provider)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table_name(name))


def append(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """Add rows, by column name."""
    spark = df.sparkSession
    columns = spark.table(table_name(name)).columns
    out = laid_out(df, partition_columns(spark, name), cluster_by)
    out.select(*[column(c) for c in columns]).write.insertInto(table_name(name))


FILE_FORMATS = ("parquet", "orc", "json", "csv", "text", "avro", "hive")


def has_row_changes(spark: SparkSession, name: str) -> bool:
    """Whether the table's provider, not being one of Spark's file formats, can MERGE."""
    return described(spark, name)[1].get("Provider", "hive").lower() not in FILE_FORMATS


def merge_into(source: DataFrame, name: str, keys: Sequence[str]) -> None:
    """Merge through the table's own row-level support: one row per key in ``source``."""
    target = table_name(name)
    on = F.lit(True)
    for key in keys:
        on = on & (F.col(f"{target}.{quoted(key)}") == field("s", key))
    given = {c: field("s", c) for c in source.columns}
    changes = {c: v for c, v in given.items() if c not in keys}
    writer = source.alias("s").mergeInto(target, on)
    if changes:
        writer = writer.whenMatched().update(changes)
    writer.whenNotMatched().insert(given).merge()


def swap(df: DataFrame, name: str) -> None:
    """Replace an unpartitioned table's rows and columns, reading it meanwhile if need be.

    For parquet the new version goes to a fresh folder and the catalog is then pointed at it, so
    there is no moment without a table, a failed write changes nothing, and nothing is
    copied. The previous version's folder is removed last; as after any overwrite of a file
    table, other sessions that read it before must refresh it. Tables of another file format are
    overwritten in place by their own writer, from a staged copy of the new rows.
    """
    spark = df.sparkSession
    partitions, details = described(spark, name)
    if partitions:
        raise ValueError(f"{name} is partitioned; replace its partitions instead")
    if _loses_columns(spark, df, name):
        return _rebuild(df, name, partitions, details)
    quoted_name = table_name(name)
    if details.get("Provider", "hive").lower() != "parquet":
        ready = staged(df, "swap")
        add_columns(spark, df, name)
        ready.select(*[column(c) for c in spark.table(quoted_name).columns]).write.insertInto(quoted_name, overwrite=True)
        spark.catalog.refreshTable(name)
        return
    old = details["Location"]
    new = f"{old.rstrip('/').split(_VERSION)[0]}{_VERSION}{uuid.uuid4().hex[:12]}"
    df.write.format("parquet").save(new)
    add_columns(spark, df, name)
    spark.sql(f"ALTER TABLE {quoted_name} SET LOCATION {text_literal(new)}")
    spark.catalog.refreshTable(name)
    remove_folder(spark, old)


def _loses_columns(spark: SparkSession, df: DataFrame, name: str) -> bool:
    """Whether ``df`` lacks or retypes columns of the table, which a file table cannot alter in place."""
    given = {f.name: f.dataType for f in df.schema}
    return any(given.get(f.name) != f.dataType for f in spark.table(table_name(name)).schema)


def add_columns(spark: SparkSession, df: DataFrame, name: str) -> None:
    have = spark.table(table_name(name)).columns
    added = [f"{quoted(f.name)} {f.dataType.simpleString()}" for f in df.schema if f.name not in have]
    if added:
        spark.sql(f"ALTER TABLE {table_name(name)} ADD COLUMNS ({', '.join(added)})")


def _rebuild(df: DataFrame, name: str, partitions: Sequence[str], details: dict[str, str]) -> None:
    """Replace a table by one with other columns or partitions: made whole under another name,
    then renamed.

    Dropping the old table and renaming the new one are noted beforehand, so a run that dies
    there is finished by the next one (:func:`finish_rename`). A managed table stays managed; an external one
    stays external, in a new folder beside.
    """
    lost = [c for c in partitions if c not in df.columns]
    if lost:
        raise ValueError(f"{name} is partitioned by {lost}, which the new rows lack")
    spark = df.sparkSession
    stem, _, last = name.rpartition(".")
    made = f"{stem}{'.' if stem else ''}{last}__new_{uuid.uuid4().hex[:8]}"
    path = None
    if details.get("Type", "").upper() == "EXTERNAL":
        path = f"{details['Location'].rstrip('/').split(_VERSION)[0]}{_VERSION}{uuid.uuid4().hex[:12]}"
    create(df, made, partitions, provider=details.get("Provider", "parquet"), path=path)
    with journal.intent(spark, name, "rename", made=made):
        finish_rename(spark, name, made)


def finish_rename(spark: SparkSession, name: str, made: str) -> None:
    """Let the table ``made`` take the place of ``name``, however far a run got with that."""
    if table_exists(spark, made):
        spark.sql(f"DROP TABLE IF EXISTS {table_name(name)}")
        spark.sql(f"ALTER TABLE {table_name(made)} RENAME TO {table_name(name)}")
    if partition_columns(spark, name):  # some catalogs leave partitions where they were before the rename
        spark.sql(f"MSCK REPAIR TABLE {table_name(name)} DROP PARTITIONS")
        spark.sql(f"MSCK REPAIR TABLE {table_name(name)} ADD PARTITIONS")
    spark.catalog.refreshTable(name)


def replace_table(df: DataFrame, name: str) -> None:
    """Replace a partitioned table by an unpartitioned one of other rows and columns."""
    _rebuild(df, name, (), described(df.sparkSession, name)[1])


def rewrite(df: DataFrame, name: str) -> None:
    """Replace all rows of a table, whether or not it is partitioned, and its columns.

    A partitioned table gets every partition that ``df`` fills; those it leaves empty are
    dropped after that. ``df`` is written out first, being needed for both.
    """
    spark = df.sparkSession
    partitions, details = described(spark, name)
    if not partitions:
        return swap(df, name)
    if len(partitions) > 1:
        raise ValueError(f"{name} is partitioned by several columns: {partitions}")
    if _loses_columns(spark, df, name):
        return _rebuild(df, name, partitions, details)
    ready = staged(df, "rewrite")
    add_columns(spark, df, name)
    before = partition_values(spark, name)
    filled = ready.select(column(partitions[0]).cast("string")).distinct().collect()  # one row per partition
    replace_partitions(ready, name)
    drop_partitions(spark, name, partitions[0], [v for v in before if v not in {r[0] for r in filled}])


def replace_partitions(df: DataFrame, name: str, cluster_by: Sequence[str] = ()) -> None:
    """Replace exactly the partitions that occur in ``df``; others are not read or written."""
    spark = df.sparkSession
    columns = spark.table(table_name(name)).columns
    lost = [c for c in df.columns if c not in columns]
    if lost:
        raise ValueError(f"{name} lacks the columns {lost}")
    out = laid_out(df, partition_columns(spark, name), cluster_by)
    with _dynamic_overwrite(spark):
        out.select(*[column(c) for c in columns]).write.insertInto(table_name(name), overwrite=True)
    spark.catalog.refreshTable(name)


def partition_values(spark: SparkSession, name: str) -> list[str | None]:
    """Values of a single-column partitioning, from the catalog alone."""
    rows = spark.sql(f"SHOW PARTITIONS {table_name(name)}").collect()  # one row per partition
    values = [unquote(r[0].split("=", 1)[1]) for r in rows]
    return [None if v == _NULL_PARTITION else v for v in values]


def drop_partitions(spark: SparkSession, name: str, partition: str, values: Sequence) -> None:
    specs = [
        f"PARTITION ({quoted(partition)} = {'NULL' if v is None else text_literal(v)})" for v in values
    ]
    for start in range(0, len(specs), 500):
        batch = ", ".join(specs[start : start + 500])
        spark.sql(f"ALTER TABLE {table_name(name)} DROP IF EXISTS {batch}")
    if specs:
        spark.catalog.refreshTable(name)


def in_partitions(df: DataFrame, partition: str, values: Sequence) -> DataFrame:
    """Rows of the given partitions, as a filter the scan prunes by."""
    known = [v for v in values if v is not None]
    condition = column(partition).isin(known) if known else F.lit(False)
    if len(known) < len(values):
        condition = condition | column(partition).isNull()
    return df.filter(condition)


def text_literal(value) -> str:
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"


_overwriting = threading.RLock()


@contextmanager
def _dynamic_overwrite(spark: SparkSession):
    """Dynamic mode for the writes inside; the setting belongs to the session, so writes of
    this library take turns, and it is put back before the next one."""
    setting = "spark.sql.sources.partitionOverwriteMode"
    with _overwriting:
        before = spark.conf.get(setting)
        spark.conf.set(setting, "dynamic")
        try:
            yield
        finally:
            spark.conf.set(setting, before)
