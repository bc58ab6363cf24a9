"""Files in and out: JSON, JSON lines, CSV; and listing what lies under a path.

Paths are whatever the cluster's file systems accept (``s3a://``, ``hdfs://``, ``file:``).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .splits import CsvLines, JsonObjects, records, splittable

FORMATS = ("json", "jsonl", "csv")

# Doubled quotes inside quoted fields, as spreadsheet and Python writers produce them.
_CSV = {"header": True, "quote": '"', "escape": '"'}


def _known(format: str) -> str:
    if format not in FORMATS:
        raise ValueError(f"unsupported format: {format!r}, expected one of {FORMATS}")
    return format


def read_records(
    spark: SparkSession,
    path: str | list[str],
    format: str = "json",
    schema: StructType | str | None = None,
    multiline: bool = True,
) -> DataFrame:
    """Read records from files.

    ``json``: each file is one array (its elements, objects, are the rows) or one object (one row).
    With a ``schema`` large files are split across tasks; without, one task reads a file.
    ``jsonl``: one object per line, blank lines skipped; files are split across tasks.
    ``csv``: header line, every column text, an empty field is ``''``. Fields may hold line
    breaks; large files are split across tasks all the same, after a pass that finds what
    lies in quotes (see :mod:`.splits`). ``multiline=False`` saves that pass where fields are
    known to hold none. Records end with LF or CRLF.

    Both passes list the files once. Files in folders that stand for column values
    (``day=1/``) are read with these columns, one task a file.

    Give a ``schema`` for JSON wherever it is known: inferring one reads the data twice.
    """
    _known(format)
    reader = spark.read
    if format == "csv":
        frame = reader.options(**_CSV, multiLine=multiline, inferSchema=False).csv(path)
        if multiline and splittable(spark, path):
            names = [*frame.columns[:-1], frame.columns[-1].removesuffix("\r")]
            frame = _fields(records(spark, path, CsvLines()), names)
        return frame.fillna("")
    if format == "json" and schema is not None and splittable(spark, path):
        found = records(spark, path, JsonObjects())
        return found.select(F.from_json("record", _schema(schema)).alias("r")).select("r.*")
    if schema is not None:
        reader = reader.schema(schema)
    return reader.option("multiLine", format == "json").json(path)


def _schema(schema: StructType | str) -> StructType:
    return schema if isinstance(schema, StructType) else StructType.fromDDL(schema)


def _fields(found: DataFrame, names: list[str]) -> DataFrame:
    """CSV records as text columns, without the header of each file."""
    wanted = ", ".join(f"_{k} string" for k in range(len(names)))
    options = {**_CSV, "header": "false", "multiLine": "true", "maxCharsPerColumn": "-1"}
    parsed = found.filter(~F.col("first")).select(F.from_csv("record", wanted, options).alias("r"))
    return parsed.select(*[F.col(f"r._{k}").alias(name) for k, name in enumerate(names)])


def write_records(df: DataFrame, path: str, format: str = "json", mode: str = "errorifexists") -> None:
    """Write part files in parallel; both JSON forms become one object per line.

    NULL JSON fields are written out. In CSV, NULL and ``''`` are both an empty field.
    """
    _known(format)
    writer = df.write.mode(mode)
    if format == "csv":
        keep_spaces = {"ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
        writer.options(**_CSV, **keep_spaces, emptyValue="").csv(path)
    else:
        writer.option("ignoreNullFields", False).json(path)


def list_objects(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(path, length, modificationTime) of every file below ``path``; contents are not read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    return reader.load(path).select("path", "length", "modificationTime")
