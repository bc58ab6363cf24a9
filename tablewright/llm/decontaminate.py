"""Benchmark decontamination: one automaton over all test windows, one pass over the text.

Test questions and answers are normalised to words and cut into windows of 13 words (a
shorter item is one window). The distinct windows become the patterns of one Aho-Corasick
automaton over word numbers; each document is walked through it once, whatever the number of
windows, and every hit is mapped back to places in the original text.

At scale
--------
Documents are not shuffled and not read twice. The windows are the only data sent to every
task. Their number is counted first: an automaton holds about ``BLOCK_WINDOWS`` of them (some
tens of MB), and a larger benchmark is dealt into blocks by hash, each scanned in turn with the
hits found so far carried along, so what is broadcast stays bounded and nothing is left out.

Defined results
---------------
Null or word-free text: no words, no hits, not contaminated. Null or word-free items have no
window. Items repeated under one id count once; an item without id counts as ``null``. Rows,
also repeated ones, are judged one by one. An empty benchmark hits nothing.
"""

from __future__ import annotations

import re
import uuid

import ahocorasick
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, LongType, StringType, StructField, StructType

from ..scratch import staged
from .batches import Texts, extend, hidden, once, text_column

#: A word: ASCII letters and digits and everything beyond ASCII. In UTF-8 all bytes of the
#: latter are above 0x7F, so bytes can be matched.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
SPARK_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Windows per automaton; a window of 13 words takes about 200 bytes as Python objects.
BLOCK_WINDOWS = 200_000

FOUND = [
    ("n_words", LongType()),
    ("n_hit", LongType()),
    ("items", ArrayType(StringType())),
    ("spans", ArrayType(StructType([StructField("start", IntegerType()), StructField("end", IntegerType())]))),
    ("contaminated", BooleanType()),
]


def benchmark_windows(benchmark: DataFrame, item_col: str, text_col: str, n: int) -> DataFrame:
    """(words, item): every distinct window with every item it occurs in."""
    words = F.regexp_extract_all(F.translate(text_column(benchmark, text_col), UPPER, LOWER), F.lit(SPARK_WORD), F.lit(0))
    items = benchmark.select(F.coalesce(text_column(benchmark, item_col), F.lit("null")).alias("item"), words.alias("all"))
    starts = F.sequence(F.lit(1), F.greatest(F.size("all") - n + 1, F.lit(1)))
    return (
        items.filter(F.size("all") > 0)
        .select("item", "all", F.explode(starts).alias("at"))
        .select(F.slice("all", F.col("at"), n).alias("words"), "item")
        .distinct()
    )


class Automaton:
    """The windows of one block, as numbers of words; 0 stands for every other word."""

    def __init__(self, windows: list[tuple[list[str], list[str]]]):
        self.numbers: dict[bytes, int] = {}
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        number = self.numbers
        for words, items in windows:
            key = tuple(number.setdefault(w.encode(), len(number) + 1) for w in words)
            self.machine.add_word(key, (len(key), items))
        if windows:
            self.machine.make_automaton()
        self.empty = not windows

    def hits(self, words: list[bytes]) -> tuple[list[tuple[int, int]], set[str]]:
        """Runs [first, last) of hit words, overlapping ones united, and the items whose windows occur."""
        if self.empty:
            return [], set()
        number = self.numbers.get
        runs: list[tuple[int, int]] = []
        items: set[str] = set()
        for last, (length, found) in self.machine.iter(tuple([number(w, 0) for w in words])):
            items.update(found)
            first = last + 1 - length
            while runs and runs[-1][1] > first:
                first = min(first, runs.pop()[0])
            runs.append((first, last + 1))
        return runs, items


def find_contamination(
    docs: DataFrame,
    benchmark: DataFrame,
    *,
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    n: int = 13,
    share: int = 20,
    block_windows: int = BLOCK_WINDOWS,
) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with what was found, and the names its new columns got.

    New: n_words, n_hit (words inside any occurrence of a window), items (sorted ids of items
    with an occurring window), spans (character ranges of the hit runs in the original text)
    and contaminated (some hit, and at least one word in ``share``).
    """
    spark = docs.sparkSession
    windows = staged(benchmark_windows(benchmark, item_col, item_text_col, n), "windows")
    blocks = max(1, -(-windows.count() // block_windows))
    block = F.pmod(F.xxhash64("words", "item"), F.lit(blocks))
    names = dict(zip([name for name, _ in FOUND], hidden(docs, *[name for name, _ in FOUND]), strict=True))
    fields = [StructField(names[name], kind) for name, kind in FOUND]
    current = docs
    for k in range(blocks):
        rows = windows.filter(block == k).groupBy("words").agg(F.collect_list("item").alias("items")).collect()
        sent = spark.sparkContext.broadcast([(list(r["words"]), list(r["items"])) for r in rows])
        token, first = f"windows:{uuid.uuid4().hex}", k == 0
        carried = [] if first else [names["items"], names["spans"]]
        if not first:
            current = staged(current, "scanned")
        current = _scan(current, text_col, fields, sent, token, carried, share)
    return current, names


def _scan(docs, text_col, fields, sent, token, carried, share):
    if carried:  # an earlier block's finds: their spans and items join this block's
        old_items, old_spans = carried
        base = docs.drop(fields[0].name, fields[1].name, fields[4].name)
        keep_items, keep_spans = hidden(docs, "items_before", "spans_before")
        base = base.withColumnRenamed(old_items, keep_items).withColumnRenamed(old_spans, keep_spans)
        found = extend(base, text_col, fields, lambda: _worker(sent, token, share))
        merged_items = F.array_sort(F.array_union(keep_items, fields[2].name))
        found = found.withColumn(fields[2].name, merged_items)
        return _united(found, text_col, fields, keep_spans, share).drop(keep_items, keep_spans)
    return extend(docs, text_col, fields, lambda: _worker(sent, token, share))


def _united(found, text_col, fields, keep_spans, share):
    """Runs of two blocks as one set of runs, with the words inside counted afresh."""
    words, hit, _, spans, bad = [f.name for f in fields]
    both = F.array_sort(F.concat(keep_spans, spans))
    empty = F.expr("cast(array() as array<struct<start:int,end:int>>)")

    def join(done, span):
        last = F.element_at(done, -1)
        touches = (F.size(done) > 0) & (last["end"] > span["start"])
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], span["end"]).alias("end"))
        head = F.slice(done, F.lit(1), F.greatest(F.size(done) - 1, F.lit(0)))
        return F.when(touches, F.concat(head, F.array(longer))).otherwise(F.concat(done, F.array(span)))

    text = F.translate(F.col(f"`{text_col}`"), UPPER, LOWER)
    within = F.transform(spans, lambda s: F.regexp_count(F.substring(text, s["start"] + 1, s["end"] - s["start"]), F.lit(SPARK_WORD)))
    found = found.withColumn(spans, F.aggregate(both, empty, join))
    found = found.withColumn(hit, F.aggregate(within, F.lit(0).cast("bigint"), lambda a, x: a + x))
    return found.withColumn(bad, (F.col(hit) > 0) & (F.col(hit) * share >= F.col(words)))


def _worker(sent, token, share):
    automaton = once(token, lambda: Automaton(sent.value))

    def work(texts: Texts):
        n_words, n_hit, items, spans, bad = [], [], [], [], []
        for text in texts:
            lower = (text or b"").lower()  # of bytes: A-Z only
            words = WORD.findall(lower)
            runs, found = automaton.hits(words)
            hit = sum(b - a for a, b in runs)
            n_words.append(len(words))
            n_hit.append(hit)
            items.append(sorted(found))
            spans.append(_places(lower, runs))
            bad.append(hit > 0 and share * hit >= len(words))
        return n_words, n_hit, items, spans, bad

    return work


def _places(text: bytes, runs: list[tuple[int, int]]) -> list[dict[str, int]]:
    """Runs of words as ranges of characters."""
    if not runs:
        return []
    at = [(m.start(), m.end()) for m in WORD.finditer(text)]
    places, chars, done = [], 0, 0
    for a, b in runs:
        start, end = at[a][0], at[b - 1][1]
        chars += len(text[done:start].decode())
        size = len(text[start:end].decode())
        places.append({"start": chars, "end": chars + size})
        chars, done = chars + size, end
    return places


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """The documents that are not contaminated, with the columns they had."""
    found, names = find_contamination(docs, benchmark, **options)
    return found.filter(~F.col(names["contaminated"])).select(*[F.col(f"`{c}`") for c in docs.columns])
