"""Statistics of a text that the quality operators learn from."""

from __future__ import annotations

import operator
from itertools import islice

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from .batches import Texts, extend

SYMBOLS = b"#*$%&|<>"
MARKS = b"!?;:="
UPPER = bytes(range(65, 91))
DIGITS = bytes(range(48, 58))

#: Counts of one text, in the order of :func:`counts`.
COUNTS = (
    "n_words",
    "word_chars",
    "n_symbols",
    "n_dup_lines",
    "n_repeat_words",
    "n_lines",
    "n_distinct",
    "n_same_next",
    "n_marks",
    "n_upper",
    "n_digits",
    "n_stops",
)


def repeat_words(numbers: np.ndarray, distinct: int) -> int:
    """Words inside three-word windows that occur at least twice, the first ones included.

    ``numbers`` stand for the words, below ``distinct``.
    """
    if len(numbers) < 4:
        return 0
    if distinct**3 < 1 << 62:
        keys = (numbers[:-2] * distinct + numbers[1:-1]) * distinct + numbers[2:]
    else:
        pairs = np.unique(numbers[:-1] * distinct + numbers[1:], return_inverse=True)[1]
        keys = pairs[:-1] * distinct + numbers[2:]
    ordered = np.sort(keys)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if not len(twice):
        return 0
    at = np.searchsorted(twice, keys)
    found = twice[np.minimum(at, len(twice) - 1)] == keys
    inside = np.zeros(len(numbers), bool)
    for shift in range(3):
        inside[shift : shift + len(found)] |= found
    return int(inside.sum())


def counts(text: bytes | None) -> tuple[int, ...]:
    text = text or b""
    words = text.split()
    joined = b"".join(words)
    number: dict[bytes, int] = {}
    numbers = np.array([number.setdefault(w, len(number)) for w in words], np.int64)
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    chars = len(joined.decode())

    def of(what: bytes) -> int:
        return len(joined) - len(joined.translate(None, what))

    return (
        len(words),
        chars,
        of(SYMBOLS),
        len(lines) - len(set(lines)),
        repeat_words(numbers, len(number)),
        len(lines),
        len(number),
        sum(map(operator.eq, words, islice(words, 1, None))),
        of(MARKS),
        of(UPPER),
        of(DIGITS),
        of(b".,"),
    )


def with_counts(docs: DataFrame, text_col: str, prefix: str = "") -> DataFrame:
    fields = [StructField(prefix + name, LongType()) for name in COUNTS]

    def start():
        def work(texts: Texts):
            rows = [counts(t) for t in texts]
            return [list(column) for column in zip(*rows, strict=True)] if rows else [[] for _ in COUNTS]

        return work

    return extend(docs, text_col, fields, start)


def ratios(prefix: str = "") -> dict[str, Column]:
    """Numbers that do not grow with the text; zero for a text without words."""
    n = {name: F.col(prefix + name).cast("double") for name in COUNTS}
    words, chars = F.greatest(n["n_words"], F.lit(1.0)), F.greatest(n["word_chars"], F.lit(1.0))
    return {
        "log_words": F.log1p(n["n_words"]),
        "word_length": n["word_chars"] / words,
        "symbols": n["n_symbols"] / words,
        "dup_lines": n["n_dup_lines"] / F.greatest(n["n_lines"], F.lit(1.0)),
        "repeats": n["n_repeat_words"] / words,
        "distinct": n["n_distinct"] / words,
        "same_next": n["n_same_next"] / words,
        "marks": n["n_marks"] / words,
        "upper": n["n_upper"] / chars,
        "digits": n["n_digits"] / chars,
        "stops": n["n_stops"] / words,
        "lines": n["n_lines"] / words,
    }
