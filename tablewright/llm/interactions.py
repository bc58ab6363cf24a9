"""How filters interact: what every order of applying them keeps, removes and loses.

Each document fails or passes each of n filters, which makes a cell of a tensor with one axis of
two per filter. Per part of the corpus Spark counts the documents of every cell. Everything asked
of any order is then a contraction of that tensor: along each axis a step selects what passes,
what fails, or all.

    kept         passes what was applied, all elsewhere
    removed      passes what was applied before, fails this filter, all elsewhere
    redundant    fails this filter, all elsewhere, less what is removed here
    unique_fails fails this filter, passes every other
    shapley      removed by this filter, summed over all orders

At scale: the tests of a document are one pass over its text (DataFrame functions only), written
once as a few numbers. A test against the rest of the table is a grouping by the text's hash, whose
least id is combined before its shuffle; only texts that occur twice meet the documents again, by a
join that adaptive execution can split. Cells are counted before their shuffle: 2**n rows a part
and task. Contractions run per part, in Spark tasks; nothing comes to the driver.

Defined results: null text is empty; a null part is the empty string. A row without an id is
identical to no smaller one, and no label is its own. Rows of equal id and text are not smaller than each
other, so both stay. A document is good (toxic) if any of its labels says so. An empty table has no
part and so no row.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import lru_cache
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.merge import own_shuffle
from ..scratch import discarding_stages, staged
from .batches import text_column

#: n filters have n! orders of n steps a part; more are refused.
MOST_FILTERS = 7
WORD = r"[^\x20\x09-\x0D]+"
SYMBOLS = "#$%&*|"
#: Measures of a cell: all documents, good ones, toxic ones.
MEASURES = ("n", "good", "toxic")
RESULTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")

PASS, FAIL, ALL = np.array([1, 0]), np.array([0, 1]), np.array([1, 1])


def text_tests(text: Column) -> dict[str, Column]:
    """The failure conditions that a text alone decides, by filter letter."""
    words = F.regexp_extract_all(text, F.lit(WORD), F.lit(0))
    return {
        "A": F.size(words) < 200,
        "B": 100 * F.size(F.array_distinct(words)) < 50 * F.size(words),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 3 * F.length(text),
        "D": text.rlike(f"[{SYMBOLS}]"),
    }


def with_copies(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` (id, hash, ...) with a flag ``name``: the same hash has a smaller id.

    The hash is of 256 bits, so equal hashes are equal texts.
    """
    several = rows.groupBy("hash").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    several = own_shuffle(several.select(F.col("hash").alias("same"), "least"))
    met = rows.join(several, F.col("hash") == F.col("same"), "left")
    return met.withColumn(name, F.coalesce(F.col("id") > F.col("least"), F.lit(False))).drop("same", "least")


def cells(rows: DataFrame, filters: Sequence[str]) -> DataFrame:
    """(part, cell, measures): how many rows of each part fail which filters; bit k is filter k.

    ``rows``: part, a boolean column per filter, and booleans ``good`` and ``toxic``.
    """
    cell = sum((F.col(f).cast("int") * (1 << k) for k, f in enumerate(filters)), F.lit(0))
    return rows.groupBy("part", cell.alias("cell")).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic")
    )


def contract(tensor: np.ndarray, filters: str) -> Iterator[dict]:
    """Rows of results for every order and step; ``tensor`` has an axis per filter, and one of measures."""
    n, axes = len(filters), "abcdefg"[: len(filters)]
    equation = f"{axes}z,{','.join(axes)}->z"

    @lru_cache(maxsize=None)
    def select(passing: frozenset, failing: str | None) -> tuple[int, ...]:
        along = [FAIL if f == failing else PASS if f in passing else ALL for f in filters]
        return tuple(int(v) for v in np.einsum(equation, tensor, *along))

    orders = list(permutations(filters))
    shapley = dict.fromkeys(filters, 0)
    for order in orders:
        for k, f in enumerate(order):
            shapley[f] += select(frozenset(order[:k]), f)[0]
    for order in orders:
        for k, f in enumerate(order):
            before = frozenset(order[:k])
            removed, good, toxic = select(before, f)
            yield {
                "filter_order": "".join(order),
                "step": k + 1,
                "kept": select(before | {f}, None)[0],
                "removed": removed,
                "redundant": select(frozenset(), f)[0] - removed,
                "unique_fails": select(frozenset(filters) - {f}, f)[0],
                "good_lost": good,
                "toxic_lost": toxic,
                "shapley": shapley[f],
            }


def audit(counts: DataFrame, filters: str) -> DataFrame:
    """(part, filter_order, step, results) from :func:`cells`; one letter names each filter."""
    if len(filters) > MOST_FILTERS or len(set(filters)) < len(filters):
        raise ValueError(f"at most {MOST_FILTERS} filters, each with a letter of its own")
    schema = "part string, filter_order string, step int, " + ", ".join(f"{r} bigint" for r in RESULTS)
    kinds = pa.schema([("part", pa.string()), ("filter_order", pa.string()), ("step", pa.int32()), *[(r, pa.int64()) for r in RESULTS]])

    def of_part(group: pa.Table) -> pa.Table:
        tensor = np.zeros((1 << len(filters), len(MEASURES)), np.int64)
        tensor[group["cell"].to_numpy()] = np.stack([group[m].to_numpy() for m in MEASURES], axis=1)
        # bit k of a cell is axis k
        tensor = tensor.reshape((2,) * len(filters) + (-1,)).transpose(*reversed(range(len(filters))), len(filters))
        part = group["part"][0].as_py()
        return pa.Table.from_pylist([{"part": part, **row} for row in contract(tensor, filters)], kinds)

    return counts.groupBy("part").applyInArrow(of_part, schema)


def audit_filters(
    docs: DataFrame,
    labels: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    part_col: str = "lang",
    good_col: str = "quality",
    toxic_col: str = "toxic",
) -> DataFrame:
    """:func:`audit` of the five filters A to E over whole documents."""
    text = F.coalesce(text_column(docs, text_col), F.lit(""))
    tests = text_tests(text)
    bare = docs.select(
        F.col(f"`{id_col}`").alias("id"),
        F.coalesce(text_column(docs, part_col), F.lit("")).alias("part"),
        F.sha2(text.cast("binary"), 256).alias("hash"),
        *[c.alias(name) for name, c in tests.items()],
    )
    marked = labels.groupBy(F.col(f"`{id_col}`").alias("labelled")).agg(
        F.max(F.col(f"`{good_col}`") == 1).alias("good"), F.max(F.col(f"`{toxic_col}`") == 1).alias("toxic")
    )
    filters = "".join([*tests, "E"])
    with discarding_stages(docs.sparkSession):
        rows = with_copies(staged(bare, "tested"), "E")
        rows = rows.join(own_shuffle(marked), F.col("id") == F.col("labelled"), "left")
        flags = [F.coalesce(m, F.lit(False)).alias(m) for m in ("good", "toxic")]
        counts = cells(rows.select("part", *filters, *flags), filters)
        return staged(audit(counts, filters), "audit", keep=True)
