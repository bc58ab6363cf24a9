"""Shared working folders for data written between jobs.

The place comes from ``spark.checkpoint.dir``, which every executor must reach. Only a
local session that names none gets a temporary folder of its own. Written tables replace
cached lineage: losing an executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import uuid
from contextlib import contextmanager
from contextvars import ContextVar

from py4j.protocol import Py4JError
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

_SETTING = "spark.checkpoint.dir"


def scratch_root(spark: SparkSession) -> str:
    folder = spark.conf.get(_SETTING, None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise RuntimeError(f"set {_SETTING} to a folder shared by all executors")
    folder = tempfile.mkdtemp(prefix="tablewright-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir().rstrip("/")


def scratch_folder(spark: SparkSession, label: str) -> str:
    """A new, unused folder path under the shared root."""
    return f"{scratch_root(spark)}/{label}-{uuid.uuid4().hex[:12]}"


class _Scope(list):
    """Folders of one :func:`discarding_stages`, and the scope around it."""

    outer: _Scope | None = None


_scope: ContextVar[_Scope | None] = ContextVar("tablewright_scope", default=None)


@contextmanager
def discarding_stages(spark: SparkSession):
    """Remove what :func:`staged` wrote inside the block when it ends.

    For jobs that commit their result before the block ends; nothing lazy may outlive it. What
    is staged to be kept passes to the block around, if there is one.
    """
    outer, folders = _scope.get(), _Scope()
    folders.outer = outer
    token = _scope.set(folders)
    try:
        yield
    finally:
        _scope.reset(token)
        for folder in folders:
            if outer is None:
                remove_folder(spark, folder)
            else:
                outer.append(folder)


def _keep_for_caller(folder: str) -> None:
    """Let the block around the innermost one, or the end of the application, remove the folder."""
    scope = _scope.get()
    if scope is not None and scope.outer is not None:
        scope.outer.append(folder)


def remove_at_exit(spark: SparkSession, folder: str) -> None:
    """Have the file system remove the folder when the application ends, if it is still there."""
    files, path = _place(spark, folder)
    files.deleteOnExit(path)


def _place(spark: SparkSession, path: str):
    """(file system, path) for a path of any store."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path


def remove_folder(spark: SparkSession, folder: str) -> None:
    files, path = _place(spark, folder)
    files.delete(path, True)


def path_exists(spark: SparkSession, name: str) -> bool:
    files, path = _place(spark, name)
    return files.exists(path)


def write_text(spark: SparkSession, name: str, text: str) -> None:
    """A small file that appears whole or not at all."""
    files, path = _place(spark, name)
    made = _place(spark, f"{name}.{uuid.uuid4().hex[:8]}.tmp")[1]
    stream = files.create(made, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    files.delete(path, False)
    if not files.rename(made, path):
        raise OSError(f"could not write {name}")


def read_text(spark: SparkSession, name: str) -> str:
    files, path = _place(spark, name)
    stream = files.open(path)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def write_mark(spark: SparkSession, name: str) -> None:
    """An empty file."""
    files, path = _place(spark, name)
    files.create(path, True).close()


def move_files(spark: SparkSession, folder: str, to: str, suffix: str) -> None:
    """Move the files of one written batch; their names are unique."""
    files, path = _place(spark, folder)
    for status in files.listStatus(path):
        name = status.getPath().getName()
        if name.endswith(suffix) and not files.rename(status.getPath(), _place(spark, f"{to.rstrip('/')}/{name}")[1]):
            raise OSError(f"could not move {status.getPath()}")


def discard_later(folder: str) -> None:
    """Let the enclosing :func:`discarding_stages`, if any, remove the folder when it ends."""
    if _scope.get() is not None:
        _scope.get().append(folder)


def staged(df: DataFrame, label: str = "stage", keep: bool = False) -> DataFrame:
    """Write ``df`` once and read it back. With ``keep`` it outlives the innermost
    :func:`discarding_stages`. What no such block removes goes when the application ends.

    Used where a plan reads its source several times: the query runs once, every reader
    sees the same rows, and the file sizes tell Spark truthfully whether it may broadcast.
    """
    path = scratch_folder(df.sparkSession, label)
    if keep:
        _keep_for_caller(path)
    else:
        discard_later(path)
    df.write.parquet(path)
    if _scope.get() is None or keep:
        remove_at_exit(df.sparkSession, path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def observed(observation: Observation, name: str) -> int:
    """A count observed by a query that has run; Spark reports none for a plan it found empty."""
    try:
        return observation.get[name]
    except Py4JError:
        return 0


class Rounds:
    """Rows found by an iterative job, one written folder per round.

    ``new`` is how many rows of the last round count, known from the write itself.
    """

    def __init__(self, spark: SparkSession, label: str, schema: StructType):
        self._spark = spark
        self._schema = schema
        self._folder = scratch_folder(spark, label)
        self._paths: list[str] = []
        self.new = 0
        discard_later(self._folder)

    def add(self, df: DataFrame, counting: Column | None = None) -> DataFrame:
        path, seen = f"{self._folder}/round-{len(self._paths):05d}", Observation()
        df.observe(seen, F.count_if(F.lit(True) if counting is None else counting).alias("new")).write.parquet(path)
        self._paths.append(path)
        self.new = observed(seen, "new")
        return self.last()

    def last(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(self._paths[-1])

    def all(self) -> DataFrame:
        return self._spark.read.schema(self._schema).parquet(*self._paths)
