"""Column-level building blocks: keys, hashes, change tests, partition values."""

from .columns import (
    any_difference,
    equal_keys,
    field,
    has_key,
    key_list,
    moment,
    row_hash,
)
from .partitioning import date_partition, list_partition, range_partition

__all__ = [
    "any_difference",
    "date_partition",
    "equal_keys",
    "field",
    "has_key",
    "key_list",
    "list_partition",
    "moment",
    "range_partition",
    "row_hash",
]
