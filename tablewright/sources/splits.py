"""Records of large files whose borders no task can see on its own: quoted CSV and JSON arrays.

Spark cuts a file into blocks and its text source gives every task the pieces (lines, or what lies
between two closing braces) of its blocks. Whether the end of a piece ends a record depends on
what stands before: a line break inside quotes does not, nor does a brace inside a string or a
nested object. So two passes are made.

The first sums up each block: in which state it ends if it begins outside of a quoted part, in
which if inside, and how many braces it leaves open in either case. A window over the blocks of
a file chains these summaries, which gives the true state every block begins in. That table (a
start, a flag and a depth a block, a path a file) is all that is sent to the tasks; it is a
ten-millionth of blocks of 128 MB, and its length is checked.

The second pass cuts each block into records. What a block has of records that reach over its
borders it gives as fragments, which are put together by (file, block the record begins in): a
group is one record, whatever the file's size.
Records inside blocks and fragments are two branches of the plan, so this pass runs once for each.

A block that the first pass did not see (its size was set anew between the passes) fails the
query instead of being read in a wrong state.
"""

from __future__ import annotations

import re
from abc import ABC, abstractmethod
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Blocks whose states are sent to every task: 256 TB in blocks of 128 MB.
MOST_BLOCKS = 1 << 21

SUMMARY = "file string, start bigint, out0 boolean, out1 boolean, depth0 bigint, depth1 bigint"
RECORDS = "file string, start bigint, kind string, first boolean, record string"
_ARROW_SUMMARY = pa.schema(
    [("file", pa.string()), ("start", pa.int64()), ("out0", pa.bool_()), ("out1", pa.bool_()), ("depth0", pa.int64()), ("depth1", pa.int64())]
)
_ARROW_RECORDS = pa.schema([("file", pa.string()), ("start", pa.int64()), ("kind", pa.string()), ("first", pa.bool_()), ("record", pa.string())])
BATCH = 4096


class Form(ABC):
    """How pieces end, and what a piece does to the state (inside a quoted part, open braces)."""

    end: str
    #: Pieces without any of these characters leave the state as it is, and each is a record.
    marks: str

    @abstractmethod
    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        """The state after a piece, and the change of depth, its end included."""

    @abstractmethod
    def begun(self, record: str) -> str:
        """A record without what stands before it; empty if none has begun."""


class CsvLines(Form):
    """Lines of CSV: a quote opens a field at its start only, and two quotes inside are one."""

    end, marks = "\n", '"'
    _FIELD = r'(?:"(?:[^"]|"")*+"[^,]*+|[^",][^,]*+|)'
    _OPEN = rf'(?:{_FIELD},)*+"(?:[^"]|"")*+'
    _FROM_OUTSIDE = re.compile(_OPEN, re.DOTALL)
    _FROM_INSIDE = re.compile(rf'(?:[^"]|"")*+(?:"[^,]*+,{_OPEN})?+', re.DOTALL)

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        if '"' not in piece:
            return inside, 0
        return (self._FROM_INSIDE if inside else self._FROM_OUTSIDE).fullmatch(piece) is not None, 0

    def begun(self, record: str) -> str:
        return record.removesuffix("\r")


class JsonObjects(Form):
    """Outermost objects, in an array or not; brackets and commas between them do not matter."""

    end, marks = "}", ""
    _ESCAPED = re.compile(r"\\.", re.DOTALL)

    def step(self, piece: str, inside: bool) -> tuple[bool, int]:
        parts = (self._ESCAPED.sub("", piece) if "\\" in piece else piece).split('"')
        outside = parts[inside::2]
        ends_inside = inside ^ (len(parts) % 2 == 0)
        return ends_inside, sum(p.count("{") for p in outside) - (not ends_inside)

    def begun(self, record: str) -> str:
        at = record.find("{")
        return record[at:] if at >= 0 else ""


def splittable(spark: SparkSession, path: str | list[str]) -> bool:
    """Whether the files are not in folders that stand for column values."""
    return spark.read.text(path).columns == ["value"]


def pieces(spark: SparkSession, path: str | list[str], form: Form) -> DataFrame:
    found = spark.read.option("lineSep", form.end).text(path)
    return found.select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"))


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[str, int, pa.Array]]:
    """(file, start, pieces) of consecutive rows of one block; a block may come in several."""
    for batch in batches:
        values, files, starts = batch.columns
        at, n = 0, batch.num_rows
        while at < n:
            file, start = files[at].as_py(), starts[at].as_py()
            same = pc.and_(pc.equal(files, file), pc.equal(starts, start)).slice(at)
            length = pc.index(same, False).as_py()
            length = n - at if length < 0 else length
            yield file, start, values.slice(at, length)
            at += length


def _plain(values: pa.Array, form: Form) -> bool:
    return bool(form.marks) and not pc.any(pc.match_substring(values, form.marks)).as_py()


def summaries(found: DataFrame, form: Form) -> DataFrame:
    """One row per block: the state it ends in and its change of depth, for both states it may begin in."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, ends, depths, done = None, [False, True], [0, 0], []
        for file, start, values in _blocks(batches):
            if block != (file, start):
                if block:
                    done.append((*block, *ends, *depths))
                block, ends, depths = (file, start), [False, True], [0, 0]
            if _plain(values, form):
                continue
            for piece in values.to_pylist():
                for k in (0, 1):
                    ends[k], change = form.step(piece, ends[k])
                    depths[k] += change
        if block:
            done.append((*block, *ends, *depths))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*done), _ARROW_SUMMARY)], schema=_ARROW_SUMMARY)

    return found.mapInArrow(work, SUMMARY)


def states(summary: DataFrame) -> DataFrame:
    """(file, start, inside, depth): the state every block begins in.

    A block either turns the state (or leaves it), or ends in one whatever it began in; so the
    state is that of the last block of the second kind, turned as often as blocks since did.
    """
    before = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    through = Window.partitionBy("file").orderBy("start").rowsBetween(Window.unboundedPreceding, 0)
    settled = F.col("out0") == F.col("out1")
    turns = F.sum(F.when(F.col("out0") & ~F.col("out1"), 1).otherwise(0)).over(through)
    known = summary.withColumn("turns", turns)
    last = F.last(F.when(settled, F.struct("out0", "turns")), ignorenulls=True).over(before)
    known = known.withColumn("last", last).withColumn("until", F.last("turns").over(before))
    turned = (F.coalesce("until", F.lit(0)) - F.coalesce("last.turns", F.lit(0))) % 2 == 1
    known = known.withColumn("inside", F.coalesce("last.out0", F.lit(False)) != turned)
    change = F.when(F.col("inside"), F.col("depth1")).otherwise(F.col("depth0"))
    return known.select("file", "start", "inside", F.coalesce(F.sum(change).over(before), F.lit(0)).alias("depth"))


class _Block:
    """The records of one block, from the state it begins in."""

    def __init__(self, form: Form, file: str, start: int, state: tuple[bool, int]):
        self.form, self.file, self.start = form, file, start
        self.inside, self.depth = state
        self.open = self.inside or self.depth > 0
        self.head = self.open  # what comes first belongs to a record of an earlier block
        self.first = start == 0
        self.parts: list[str] = []

    def feed(self, values: pa.Array) -> Iterator[tuple]:
        if not self.open and _plain(values, self.form):
            for piece in values.to_pylist():
                yield from self._record(piece)
            return
        for piece in values.to_pylist():
            ends_inside, change = self.form.step(piece, self.inside)
            self.inside, self.depth = ends_inside, max(0, self.depth + change)
            self.parts.append(piece)
            self.open = self.inside or self.depth > 0
            if not self.open:
                # the end of a CSV line is not part of the record, a brace is
                whole = self.form.end.join(self.parts) + self.form.end.strip()
                self.parts.clear()
                yield from self._record(whole)

    def _record(self, text: str) -> Iterator[tuple]:
        if self.head:
            self.head = False
            yield self.file, self.start, "head", False, text
            return
        record = self.form.begun(text)
        if record:
            yield None, None, None, self.first, record
            self.first = False

    def close(self) -> Iterator[tuple]:
        if not self.parts:
            return
        text = self.form.end.join(self.parts) + self.form.end
        if self.head:
            yield self.file, self.start, "middle", False, text
        elif begun := self.form.begun(text):
            yield self.file, self.start, "tail", self.first, begun


def records(spark: SparkSession, path: str | list[str], form: Form) -> DataFrame:
    """(record, first): every record of the files, and whether it is the first of its file.

    The blocks are summed up when this is called, the records are read when they are needed.
    Blank lines are no records. A record that is never closed reaches to the end of its file.
    """
    found = pieces(spark, path, form)
    known = states(summaries(found, form)).filter("start > 0")
    per_file = known.groupBy("file").agg(F.array_sort(F.collect_list(F.struct("start", "inside", "depth"))).alias("blocks"))
    table, total = {}, 0
    for row in per_file.toLocalIterator():
        total += len(row["blocks"])
        if total > MOST_BLOCKS:
            raise ValueError(f"more than {MOST_BLOCKS} blocks; raise spark.sql.files.maxPartitionBytes or read fewer files at once")
        starts, insides, depths = zip(*row["blocks"], strict=True)
        table[row["file"]] = (list(starts), bytes(insides), list(depths))
    sent = spark.sparkContext.broadcast(table)

    def state_of(file: str, start: int) -> tuple[bool, int]:
        if start == 0:
            return False, 0
        starts, insides, depths = sent.value.get(file, ([], b"", []))
        at = bisect_left(starts, start)
        if at == len(starts) or starts[at] != start:
            raise ValueError(f"{file} was cut into other blocks when it was summed up; read it anew under the present settings")
        return bool(insides[at]), depths[at]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        block = None
        for file, start, values in _blocks(batches):
            if block is None or (block.file, block.start) != (file, start):
                if block:
                    yield from block.close()
                block = _Block(form, file, start, state_of(file, start))
            yield from block.feed(values)
        if block:
            yield from block.close()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for row in rows(batches):
            held.append(row)
            if len(held) == BATCH:
                yield _batch(held)
                held = []
        if held:
            yield _batch(held)

    cut = found.mapInArrow(work, RECORDS)
    return cut.filter("kind IS NULL").select("record", "first").unionByName(_joined(cut.filter("kind IS NOT NULL"), form))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _ARROW_RECORDS)], schema=_ARROW_RECORDS)


def _joined(fragments: DataFrame, form: Form) -> DataFrame:
    """Records over several blocks: each fragment goes to the last record begun before it."""
    begins = F.col("kind") == "tail"
    order = Window.partitionBy("file").orderBy("start", begins).rowsBetween(Window.unboundedPreceding, 0)
    placed = fragments.withColumn("record_start", F.last(F.when(begins, F.col("start")), ignorenulls=True).over(order))
    parts = F.array_sort(F.collect_list(F.struct("start", "record")))
    whole = placed.groupBy("file", "record_start").agg(
        F.array_join(F.transform(parts, lambda p: p["record"]), "").alias("record"),
        F.max("first").alias("first"),
    )
    if form.end == "\n":
        whole = whole.withColumn("record", F.regexp_replace("record", r"\r?\n?\z", ""))
    return whole.select("record", "first")
