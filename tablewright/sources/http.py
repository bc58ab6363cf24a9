"""JSON over HTTP as Spark data sources: paged reads and batched posts.

``paged_http`` plans one task per range of pages, so pages are fetched in parallel by the
executors. Each record arrives as JSON text; :func:`parsed` turns it into columns inside
Spark. ``http_post`` sends rows from every partition.

Option ``url`` may hold ``{page}`` and ``{per_page}``; otherwise they become query
parameters, beside those of ``params``. ``method`` and ``json_body`` make it a query by POST. Besides http(s), any file system Arrow can open serves as a source of pages;
a page that is missing there counts as empty.
"""

from __future__ import annotations

import base64
import json
import sys
import urllib.parse
import urllib.request
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    InputPartition,
    WriterCommitMessage,
)

RECORD_SCHEMA = "page int, record string"


def auth_headers(kind: str = "", token: str = "", header: str = "X-API-Key", user: str = "", password: str = "") -> dict[str, str]:
    """Headers for ``bearer``, ``api_key`` or ``basic`` authentication."""
    if not kind:
        return {}
    if kind == "bearer":
        return {"Authorization": f"Bearer {token}"}
    if kind == "api_key":
        return {header: token}
    if kind == "basic":
        pair = base64.b64encode(f"{user}:{password}".encode()).decode()
        return {"Authorization": f"Basic {pair}"}
    raise ValueError(f"unknown authentication {kind!r}")


def headers_from(options: dict) -> dict[str, str]:
    """Every option ``header.<name>``, plus authentication from the ``auth.*`` options."""
    plain = {k[len("header.") :]: v for k, v in options.items() if k.lower().startswith("header.")}
    auth = {k[len("auth.") :]: v for k, v in options.items() if k.lower().startswith("auth.")}
    return {**plain, **auth_headers(**auth)}


def fetch(url: str, headers: dict[str, str], timeout: float, method: str = "GET", body: str | None = None) -> str | None:
    """What ``url`` answers, sent ``body`` (JSON) if there is one; None for a file that does not exist."""
    if url.startswith(("http://", "https://")):
        request = request_for(url, headers, method, body)
        with urllib.request.urlopen(request, timeout=timeout) as response:
            return response.read().decode("utf-8")
    from pyarrow import fs

    if url.startswith("file:"):  # Hadoop writes file:/x, Arrow wants file:///x
        url = "file://" + urllib.parse.urlparse(url).path
    files, path = fs.FileSystem.from_uri(url)
    info = files.get_file_info(path)
    if info.type == fs.FileType.Directory:  # one page written by Spark: its part file
        inside = files.get_file_info(fs.FileSelector(path))
        paths = sorted(f.path for f in inside if f.base_name.startswith("part-") and f.size)
        if len(paths) > 1:
            raise ValueError(f"{url} holds {len(paths)} files, but a page is one document")
        return files.open_input_stream(paths[0]).read().decode("utf-8") if paths else None
    if info.type == fs.FileType.NotFound:
        return None
    return files.open_input_stream(path).read().decode("utf-8")


def request_for(url: str, headers: dict[str, str], method: str, body: str | None) -> urllib.request.Request:
    data = None if body is None else body.encode("utf-8")
    kind = {} if body is None else {"Content-Type": "application/json"}
    return urllib.request.Request(url, data=data, headers={**kind, **headers}, method=method.upper())


def records_at(body: str | None, response_path: str) -> list:
    """Follow a dotted path; a list gives its items, anything else one record."""
    data = json.loads(body) if body else None
    for key in filter(None, response_path.split(".")):
        data = data[key] if data else None
    if not data:
        return []
    return data if isinstance(data, list) else [data]


@dataclass
class PageRange(InputPartition):
    first: int
    last: int


class PagedHttpReader(DataSourceReader):
    def __init__(self, options: dict):
        self.url = options["url"]
        self.headers = headers_from(options)
        self.timeout = float(options.get("timeout", 30))
        self.paginate = str(options.get("paginate", "true")).lower() == "true"
        self.page_param = options.get("page_param", "page")
        self.per_page_param = options.get("per_page_param", "per_page")
        self.per_page = int(options.get("per_page", 100))
        self.max_pages = int(options.get("max_pages", 100))
        self.stop_at_bound = str(options.get("stop_at_bound", "false")).lower() == "true"
        self.pages_per_task = max(1, int(options.get("pages_per_task", 10)))
        self.response_path = options.get("response_path", "")
        self.method = options.get("method", "GET")
        self.params = json.loads(options.get("params", "{}"))
        self.body = options.get("json_body")
        if self.body is not None:
            json.loads(self.body)  # a body that is not JSON fails here, not on the executors

    def page_url(self, page: int) -> str:
        url, query = self.url, dict(self.params)
        if "{page}" in url:
            url = url.replace("{page}", str(page)).replace("{per_page}", str(self.per_page))
        elif self.paginate:
            query |= {self.page_param: page, self.per_page_param: self.per_page}
        if not query:
            return url
        return f"{url}{'&' if '?' in url else '?'}{urllib.parse.urlencode(query, doseq=True)}"

    def page(self, number: int) -> list:
        return records_at(fetch(self.page_url(number), self.headers, self.timeout, self.method, self.body), self.response_path)

    def partitions(self) -> list[InputPartition]:
        if not self.paginate:
            return [PageRange(1, 1)]
        step = self.pages_per_task
        return [PageRange(n, min(n + step - 1, self.max_pages)) for n in range(1, self.max_pages + 1, step)]

    def read(self, partition: PageRange) -> Iterator[tuple]:
        for page in range(partition.first, partition.last + 1):
            records = self.page(page)
            if not records:
                return  # past the end: every later page is empty too
            for record in records:
                yield page, json.dumps(record, ensure_ascii=False)
        if self.paginate and partition.last == self.max_pages and not self.stop_at_bound:
            beyond = self.max_pages + 1
            if self.page(beyond):
                raise RuntimeError(f"page {beyond} has records too: raise max_pages, or set stop_at_bound to leave them out")


class PagedHttp(DataSource):
    @classmethod
    def name(cls) -> str:
        return "paged_http"

    def schema(self) -> str:
        return RECORD_SCHEMA

    def reader(self, schema) -> PagedHttpReader:
        return PagedHttpReader(dict(self.options))


@dataclass
class Sent(WriterCommitMessage):
    rows: int


class HttpPostWriter(DataSourceArrowWriter):
    """Posts each row, or each batch of ``batch_size`` rows as one array.

    A retried task posts its rows again; the receiver must accept a repeat.
    """

    def __init__(self, options: dict):
        self.url = options["url"]
        self.headers = {"Content-Type": "application/json", **headers_from(options)}
        self.timeout = float(options.get("timeout", 30))
        self.batch_size = int(options.get("batch_size", 500))
        self.batch = str(options.get("batch", "false")).lower() == "true"

    def deliver(self, payload: str) -> None:
        request = urllib.request.Request(self.url, data=payload.encode("utf-8"), headers=self.headers, method="POST")
        with urllib.request.urlopen(request, timeout=self.timeout):
            pass

    def write(self, iterator) -> WriterCommitMessage:
        rows = 0
        for batch in iterator:
            for start in range(0, batch.num_rows, self.batch_size):
                records = batch.slice(start, self.batch_size).to_pylist()
                for payload in [records] if self.batch else records:
                    self.deliver(json.dumps(payload, default=str, ensure_ascii=False))
                rows += len(records)
        return Sent(rows)


class HttpPost(DataSource):
    @classmethod
    def name(cls) -> str:
        return "http_post"

    def writer(self, schema, overwrite: bool) -> HttpPostWriter:
        return HttpPostWriter(dict(self.options))


def register_http(spark: SparkSession, *more: type[DataSource]) -> None:
    """Make ``paged_http`` and ``http_post`` (and subclasses given) known to the session.

    The classes travel by value, so executors need not have this package installed.
    """
    for source in (PagedHttp, HttpPost, *more):
        cloudpickle.register_pickle_by_value(sys.modules[source.__module__])
        spark.dataSource.register(source)


def read_pages(spark: SparkSession, url: str, **options) -> DataFrame:
    """(page, record) with ``record`` as JSON text.

    ``params`` (a mapping) joins the query string and ``json_body`` (anything JSON can hold) is
    sent with every page; ``method`` is GET unless given.
    """
    register_http(spark)
    given = {k: json.dumps(v) if k in ("params", "json_body") else str(v) for k, v in options.items() if v is not None}
    return spark.read.format("paged_http").options(url=url, **given).load()


def post_rows(df: DataFrame, url: str, **options) -> None:
    register_http(df.sparkSession)
    df.write.format("http_post").options(url=url, **{k: str(v) for k, v in options.items()}).mode("append").save()


def parsed(records: DataFrame, schema: str, text: str = "record") -> DataFrame:
    """JSON text as typed columns."""
    return records.select(F.from_json(F.col(text), schema).alias("r")).select("r.*")


def explode_path(df: DataFrame, text: str | Column, item_schema: str, response_path: str, missing: str = "skip") -> DataFrame:
    """One row per record at a dotted path inside a JSON text column.

    An array gives its elements, an object is one record, and a scalar is one record with the
    value in the first field. A field that is absent or of another type is NULL. Text that is not JSON
    fails the query; an absent path gives no row, or with ``missing="fail"`` an error as from
    :func:`records_at`. The text is parsed once, into a VARIANT that all else is read from.
    """
    if missing not in ("skip", "fail"):
        raise ValueError(f"missing {missing!r} is neither 'skip' nor 'fail'")
    body = F.col(text) if isinstance(text, str) else text
    path = "$" + "".join(f"['{key}']" for key in response_path.split(".") if key)
    fields = T._parse_datatype_string(f"struct<{item_schema}>").fields

    def unless(bad: Column, complaint: str) -> Column:
        error = F.raise_error(F.concat(F.lit(complaint), F.substring("body", 1, 80))).cast("boolean")
        return F.when(F.col("body").isNotNull() & bad, error).otherwise(F.lit(True))

    parsed_once = df.select(body.alias("body")).select("body", F.try_parse_json("body").alias("json"))
    parsed_once = parsed_once.filter(unless(F.col("json").isNull(), "not JSON: "))
    at = parsed_once.select("body", F.try_variant_get("json", path, "variant").alias("at"))
    if missing == "fail":
        at = at.filter(unless(F.col("at").isNull(), f"no {response_path!r} in "))
    at = at.filter(F.col("at").isNotNull() & ~F.is_variant_null("at")).select("at")
    items = F.coalesce(F.try_variant_get("at", "$", "array<variant>"), F.array("at"))
    item = at.select(F.explode(items).alias("item")).withColumn("whole", F.schema_of_variant("item").startswith("OBJECT"))

    def value(k: int, f) -> Column:
        kind = f.dataType.simpleString()
        inside = F.try_variant_get("item", f"$['{f.name}']", kind)
        return F.when(F.col("whole"), inside).otherwise(F.try_variant_get("item", "$", kind) if k == 0 else F.lit(None).cast(f.dataType)).alias(f.name)

    return item.select(*[value(k, f) for k, f in enumerate(fields)])
