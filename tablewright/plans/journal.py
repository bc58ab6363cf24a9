"""A record of a change that takes two commits, written before the first of them.

A run that dies in between leaves its record, and the next run on the table finds it by one look-up
of a path, without reading the table. It then finishes or undoes what the record tells of:

    rename   a table made whole under another name takes the place of the old one: finished
    versions closed versions were appended, but the slice of current ones was not replaced: undone

Records lie in the table's database, beside its tables, so that they outlive a dropped table.
"""

from __future__ import annotations

import json
from contextlib import contextmanager

from pyspark.sql import SparkSession

from ..scratch import path_exists, read_text, remove_folder, write_text

_FOLDER = "_tablewright_journal"


def _path(spark: SparkSession, name: str) -> str:
    *database, table = [part.strip("`").lower() for part in name.split(".")]
    location = spark.catalog.getDatabase(database[-1] if database else spark.catalog.currentDatabase()).locationUri
    return f"{location.rstrip('/')}/{_FOLDER}/{table}.json"


def pending(spark: SparkSession, name: str) -> dict | None:
    """The record a died run left for the table."""
    path = _path(spark, name)
    return json.loads(read_text(spark, path)) if path_exists(spark, path) else None


def settle(spark: SparkSession, name: str) -> None:
    remove_folder(spark, _path(spark, name))


@contextmanager
def intent(spark: SparkSession, name: str, kind: str, **details: str):
    """Note what is about to be done; the record goes only when the block ends well."""
    write_text(spark, _path(spark, name), json.dumps({"kind": kind, **details}))
    yield
    settle(spark, name)
