"""Schema policies for incremental loads, and schema introspection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ByteType,
    DataType,
    DateType,
    DecimalType,
    DoubleType,
    FloatType,
    IntegerType,
    LongType,
    ShortType,
    TimestampNTZType,
)

from ..functions.columns import assigned, column

POLICIES = ("ignore", "fail", "append_new_columns", "sync_all_columns")


class SchemaChanged(ValueError):
    """The source columns differ from the target's under the ``fail`` policy."""


def conform(df: DataFrame, like: DataFrame) -> DataFrame:
    """``df`` by column name in ``like``'s order and types; columns it lacks are NULL.

    A value that its column's type cannot hold fails the query.
    """
    own = {f.name: f.dataType for f in df.schema.fields}
    extra = set(own) - set(like.columns)
    if extra:
        raise SchemaChanged(f"columns not in the target: {sorted(extra)}")
    return df.select(
        *[
            (assigned(column(f.name), own[f.name], f.dataType, f.name) if f.name in own else F.lit(None).cast(f.dataType)).alias(f.name)
            for f in like.schema.fields
        ]
    )


def align_schemas(
    target: DataFrame, source: DataFrame, policy: str, keys: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Apply a schema-change policy and return ``(target, source)``.

    ``ignore`` drops source-only columns; ``fail`` raises on any difference in names or
    types; ``append_new_columns`` gives the target the new columns as NULL;
    ``sync_all_columns`` does that, drops target columns the source no longer has, and widens
    those whose type the source's holds whole (int to bigint, date to timestamp and the like).
    """
    if policy not in POLICIES:
        raise ValueError(f"on_schema_change {policy!r} is not one of {POLICIES}")
    missing_keys = [k for k in keys if k not in source.columns or k not in target.columns]
    if missing_keys:
        raise SchemaChanged(f"key columns must be in source and target: {missing_keys}")
    new = [f for f in source.schema.fields if f.name not in target.columns]
    gone = [c for c in target.columns if c not in source.columns]

    if policy == "ignore":
        return target, source.drop(*[f.name for f in new])
    if policy == "fail":
        have = {f.name: f.dataType for f in target.schema.fields}
        retyped = [f.name for f in source.schema.fields if have.get(f.name, f.dataType) != f.dataType]
        if new or gone or retyped:
            raise SchemaChanged(
                f"new columns {[f.name for f in new]}, missing columns {gone}, changed types {retyped}"
            )
        return target, source
    widened = target.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in new])
    if policy == "sync_all_columns":
        given = {f.name: f.dataType for f in source.schema.fields}
        wider = {f.name: column(f.name).cast(given[f.name]) for f in target.schema.fields if _holds(given.get(f.name), f.dataType)}
        widened = widened.withColumns(wider).drop(*gone)
    return widened, source


def _holds(wide: DataType | None, narrow: DataType) -> bool:
    """Whether every value of the type ``narrow`` is one of the other type ``wide``."""
    whole = [ByteType(), ShortType(), IntegerType(), LongType()]
    if wide is None or wide == narrow:
        return False
    if narrow in whole:
        if wide in whole:
            return whole.index(wide) > whole.index(narrow)
        digits = (3, 5, 10, 19)[whole.index(narrow)]
        return isinstance(wide, DoubleType) and narrow != LongType() or isinstance(wide, DecimalType) and wide.precision - wide.scale >= digits
    if isinstance(narrow, DecimalType) and isinstance(wide, DecimalType):
        return wide.scale >= narrow.scale and wide.precision - wide.scale >= narrow.precision - narrow.scale
    return (narrow, wide) in ((FloatType(), DoubleType()), (DateType(), TimestampNTZType()))


def describe(df: DataFrame) -> DataFrame:
    """One row per column: position, name, type, nullability."""
    rows = [
        (i, f.name, f.dataType.simpleString(), f.nullable)
        for i, f in enumerate(df.schema.fields, start=1)
    ]
    return df.sparkSession.createDataFrame(
        rows, "ordinal_position int, column_name string, data_type string, is_nullable boolean"
    )
