"""Python over whole rows: Arrow batches in, the same rows with more columns out.

``extend`` serves every operator whose work is one text at a time. It adds no shuffle, keeps
the columns it finds (whatever their names) and holds one slice of a batch as Python objects.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import StringType, StructField, StructType

from ..scratch import discarding_stages, staged

#: Rows turned into Python objects at once.
SLICE = 128

#: What the contract of several operators calls a word, as bytes.split() without argument
#: finds it: runs without space, tab, newline, vertical tab, form feed, carriage return.
Texts = list[bytes | None]
Work = Callable[..., Sequence[list]]


def text_column(df: DataFrame, name: str) -> Column:
    """The column as text, whatever its type and however it is named."""
    return F.col(f"`{name.replace('`', '``')}`").cast("string")


def hidden(df: DataFrame, *wanted: str) -> list[str]:
    """Names like ``wanted`` that no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    found = []
    for name in wanted:
        new = f"__{name}"
        while new.lower() in taken:
            new = "_" + new
        taken.add(new.lower())
        found.append(new)
    return found


def extend(
    df: DataFrame, text_col: str, fields: Sequence[StructField], start: Callable[[], Work], also: Sequence[str] = ()
) -> DataFrame:
    """``df`` with ``fields`` appended, computed from ``text_col``.

    ``start()`` runs once per task and returns the work: from a list of UTF-8 texts (None for
    null), and one list for each column of ``also``, to one list per field.
    """
    at, others = df.columns.index(text_col), [df.columns.index(c) for c in also]
    if not isinstance(df.schema[at].dataType, StringType):
        raise TypeError(f"{text_col} is {df.schema[at].dataType.simpleString()}, not string")
    schema = StructType([*df.schema.fields, *fields])
    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                texts = part.column(at).cast(pa.binary()).to_pylist()
                made = work(texts, *[part.column(k).to_pylist() for k in others])
                more = [pa.array(values, kind) for values, kind in zip(made, kinds, strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, *more], names=names)

    return df.mapInArrow(run, schema)


def explode_texts(
    df: DataFrame, text_col: str, schema: StructType, start: Callable[[], Callable[[pa.RecordBatch, Texts], pa.RecordBatch | None]]
) -> DataFrame:
    """Rows of ``schema`` made from slices of ``df``: as many per text as the work returns."""
    at = df.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = start()
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                made = work(part, part.column(at).cast(pa.binary()).to_pylist())
                if made is not None and made.num_rows:
                    yield made

    return df.mapInArrow(run, schema)


def fold(id_col: str) -> Column:
    """crc32 of the id as text, modulo 5; labels of fold 0 are for evaluation only."""
    return F.crc32(F.col(f"`{id_col}`").cast("string").cast("binary")) % 5


def held_out(id_col: str) -> Column:
    """True in fold 0; false elsewhere and for a null id."""
    return F.coalesce(fold(id_col) == 0, F.lit(False))


def sampled_rows(rows: DataFrame, order: str, most: int) -> list:
    """At most ``most`` distinct rows, those least by ``order``, an even 64-bit hash column.

    Only rows below a hash that lets about a third more than ``most`` through are written and
    collected, so that what reaches the driver does not grow with the table or its partitions; of a
    limit over an order every partition would send its own ``most``. Copies of a row count once.
    """
    spread = rows.agg(F.approx_count_distinct(order, 0.02)).first()[0]
    share = min(1.0, 1.3 * most / max(spread, 1))
    while True:
        bound = int(share * 2**64) - 2**63
        few = rows if share >= 1 else rows.filter(F.col(order) < F.lit(bound))
        with discarding_stages(rows.sparkSession):
            few = staged(few.distinct(), "sample")
            if share >= 1 or few.count() >= most:
                return sorted(few.collect(), key=lambda r: (r[order], tuple(r)))[:most]
        share = min(1.0, 2 * share)


_KEPT: dict[str, object] = {}


def once(key: str, make: Callable[[], object]) -> object:
    """``make()`` once per worker process for this key; one object is kept per kind of key."""
    kind = key.split(":", 1)[0]
    found = _KEPT.get(kind)
    if found is None or found[0] != key:
        found = _KEPT[kind] = (key, make())
    return found[1]
