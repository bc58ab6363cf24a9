"""Where rows come from and go to: files, catalog tables, databases, HTTP."""

from .databases import bound, connection, cut_points, read_query, upsert_table, write_table
from .files import list_objects, read_records, write_records
from .http import explode_path, parsed, post_rows, read_pages, register_http
from .tables import execute, extract, load, table_schema

__all__ = [
    "bound",
    "connection",
    "cut_points",
    "execute",
    "explode_path",
    "extract",
    "list_objects",
    "load",
    "parsed",
    "post_rows",
    "read_pages",
    "read_query",
    "read_records",
    "register_http",
    "table_schema",
    "upsert_table",
    "write_records",
    "write_table",
]
