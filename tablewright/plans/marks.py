"""High-water marks kept with the files they were taken from.

The greatest value of a column is noted as a table property together with a print of the files it
covers: their number, the last time one was written, and a hash of their names, sizes and times.
The next run lists the files, which reads no data. If those up to that time still have that
print, only files written later are read, so appends by others are noticed and nothing else
is read again; if not (the table was rewritten or compacted by somebody), the whole column is.

The files are always listed before rows are read: a file that comes in between is read now and
once more by the next run, and none is taken for read that was not.
"""

from __future__ import annotations

import json
from datetime import date, datetime
from decimal import Decimal
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.watermark import high_watermark
from . import commit

_PROPERTY = "tablewright.mark."
_FORMATS = ("parquet", "orc")
#: Longer texts do not belong in a catalog.
_LONGEST = 1000

_READ = {
    T.ByteType: int,
    T.ShortType: int,
    T.IntegerType: int,
    T.LongType: int,
    T.DecimalType: Decimal,
    T.DateType: date.fromisoformat,
    T.TimestampType: datetime.fromisoformat,
    T.TimestampNTZType: str,
    T.StringType: str,
}


def kept_mark(spark: SparkSession, name: str, column: str) -> Any:
    """:func:`high_watermark` of a table's column, from what was noted and the files written since."""
    target = spark.table(commit.table_name(name))
    kind = target.schema[column].dataType
    if "_metadata" in target.columns or not _fits(spark, name, kind):
        return high_watermark(target, column)
    noted = _noted(spark, name, column, kind)
    files = _files(spark, name, noted["until"] if noted else None)
    spark.catalog.refreshTable(name)
    target = spark.table(commit.table_name(name))
    if noted is None or (files["old"], files["old_print"]) != (noted["files"], noted["print"]):
        mark = high_watermark(target, column)
    elif files["files"] == files["old"]:
        return noted["value"]
    else:
        since = F.timestamp_micros(F.lit(noted["until"]))
        added = target.filter(F.col("_metadata.file_modification_time") > since)
        mark = _greater(noted["value"], high_watermark(added, column))
    _note(spark, name, column, kind, mark, files)
    return mark


def note_rewritten(spark: SparkSession, name: str, column: str, before: Any, delivered: DataFrame) -> None:
    """Note the mark of a table whose files were just replaced, from the mark before and the rows that came in.

    For transitions that keep the greatest value of both; nothing of the table is read.
    """
    kind = spark.table(commit.table_name(name)).schema[column].dataType
    given = {f.name: f.dataType for f in delivered.schema}
    if given.get(column) == kind and _fits(spark, name, kind):
        _note(spark, name, column, kind, _greater(before, high_watermark(delivered, column)), _files(spark, name, None))


def _fits(spark: SparkSession, name: str, kind: T.DataType) -> bool:
    partitions, details = commit.described(spark, name)
    return not partitions and details.get("Provider", "hive").lower() in _FORMATS and type(kind) in _READ


def _files(spark: SparkSession, name: str, until: int | None) -> dict:
    """Number, print and last time of the table's files, and of those up to a time."""
    location = commit.described(spark, name)[1]["Location"]
    found = spark.read.format("binaryFile").load(location).select("path", "length", F.unix_micros("modificationTime").alias("at"))
    print_of = F.xxhash64("path", "length", "at")
    old = F.col("at") <= F.lit(until).cast("bigint")
    row = found.agg(
        F.count(F.lit(1)).alias("files"),
        F.max("at").alias("until"),
        F.bit_xor(print_of).alias("print"),
        F.count_if(old).alias("old"),
        F.bit_xor(F.when(old, print_of)).alias("old_print"),
    ).first()
    return row.asDict()


def _noted(spark: SparkSession, name: str, column: str, kind: T.DataType) -> dict | None:
    rows = spark.sql(f"SHOW TBLPROPERTIES {commit.table_name(name)}").filter(F.col("key") == _PROPERTY + column).collect()
    if not rows:
        return None
    noted = json.loads(rows[0]["value"])
    if noted["type"] != kind.simpleString():
        return None
    noted["value"] = None if noted["value"] is None else _READ[type(kind)](noted["value"])
    return noted


def _note(spark: SparkSession, name: str, column: str, kind: T.DataType, mark: Any, files: dict) -> None:
    text = None if mark is None else mark.isoformat() if isinstance(mark, date) else str(mark)
    if files["until"] is None or len(text or "") > _LONGEST:
        return
    noted = {"type": kind.simpleString(), "value": text, "until": files["until"], "files": files["files"], "print": files["print"]}
    key, value = commit.text_literal(_PROPERTY + column), commit.text_literal(json.dumps(noted))
    spark.sql(f"ALTER TABLE {commit.table_name(name)} SET TBLPROPERTIES ({key} = {value})")


def _greater(a: Any, b: Any) -> Any:
    return b if a is None else a if b is None else max(a, b)
