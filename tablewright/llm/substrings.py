"""Removal of passages that an earlier document already has: seed and extend.

A window of 50 consecutive words is removed from a document if the same words also occur in a
document with a smaller id. All of that is found without comparing pairs of documents.

Seeds. Every window of 50 words has one *anchor*: its 8-word gram with the smallest hash
(winnowing; Schleimer et al., 2003). Equal windows have equal anchors, so documents are joined
on anchors. Consecutive windows with the same anchor occurrence form a *segment*, about 15
windows; a document is cut into segments once.

Extension. Equal anchors are extended both ways over the whole context of the segment (its
windows from the first to the last word). Where a whole context also occurs in an earlier
document, all windows of the segment are repeats. Only where documents share the anchor but
not the whole context, as near the ends of a shared passage or around an edit, the extension is
settled window by window. The repeats that overlap are then united to maximal ones.

At scale. One row per segment is shuffled, about one per 17 words, and it has numbers only.
Groups are reduced to their smallest id before they are shuffled, and meet the rows again by
joins that adaptive execution can split, so a passage shared by a third of all documents is no
hot task. Texts are shuffled twice, by document: to settle the remaining windows, and to cut.
Hashes are compared, 64 bits of the anchor and 64 of the context or window together.

Defined results
---------------
Null or blank text: no words. Fewer than 50 words: nothing is removed. Rows with a null id are
neither removed from nor a reason to remove. Rows with equal ids are not earlier than each
other; they are told apart by a hash of their text. Ids may be of any type that has an order; whole numbers
are returned as bigint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, IntegralType, LongType, StringType, StructField, StructType

from ..operators.merge import own_shuffle
from ..scratch import discarding_stages, staged
from .batches import Texts, explode_texts, extend

GRAM = 8
BASE = 0x9E3779B97F4A7C15  # odd, so that powers do not vanish
MASK = (1 << 64) - 1
#: Fixed multipliers of a well-known 64-bit finalizer.
MIX = (0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)
#: Grams whose windows are scanned at once; bounds memory for very long texts.
BLOCK = 1 << 15


def _power(n: int) -> np.uint64:
    return np.uint64(pow(BASE, n, 1 << 64))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(MIX[0])
    h ^= h >> np.uint64(33)
    h = h * np.uint64(MIX[1])
    return h ^ (h >> np.uint64(33))


def runs_of_words(words: list[bytes]) -> list[np.ndarray]:
    """Hashes of all runs of 1, 2, 4, .. words, to build longer ones from."""
    digest = xxhash.xxh64_intdigest
    found = [np.fromiter(map(digest, words), np.uint64, len(words))]
    while 2 << len(found) - 1 <= len(words):
        size, h = 1 << len(found) - 1, found[-1]
        found.append(h[:-size] * _power(size) + h[size:])
    return found


def run_hash(runs: list[np.ndarray], starts: np.ndarray, length: int) -> np.ndarray:
    """Hashes of the runs of ``length`` words at ``starts``."""
    total, at = np.zeros(len(starts), np.uint64), starts
    for bit in reversed(range(len(runs))):
        if length >> bit & 1:
            total = total * _power(1 << bit) + runs[bit][at]
            at = at + (1 << bit)
    return _mixed(total)


def segments(words: list[bytes], window: int, gram: int = GRAM):
    """(start, windows, anchor, context) of every segment: arrays, or None if too short."""
    if len(words) < window:
        return None
    runs = runs_of_words(words)
    grams = run_hash(runs, np.arange(len(words) - gram + 1), gram)
    per = window - gram + 1
    first = np.empty(len(words) - window + 1, np.int64)
    for k in range(0, len(first), BLOCK):
        part = grams[k : k + BLOCK + per - 1]
        least = np.lib.stride_tricks.sliding_window_view(part, per).argmin(axis=1)
        first[k : k + BLOCK] = least + np.arange(k, k + len(least))
    starts = np.flatnonzero(np.r_[True, first[1:] != first[:-1]])
    ends = np.r_[starts[1:], len(first)]
    windows = run_hash(runs, np.arange(len(first)), window)
    # the context: how many windows, and all of them, through sums of their hashes
    sums = np.r_[np.uint64(0), np.cumsum(_mixed(windows ^ np.uint64(BASE)), dtype=np.uint64)]
    count = (ends - starts).astype(np.uint64)
    context = _mixed(windows[starts] * np.uint64(MIX[0]) ^ windows[ends - 1] * np.uint64(MIX[1]) ^ (sums[ends] - sums[starts]) + count)
    return starts, ends - starts, grams[first[starts]], context


SEGMENT = StructType(
    [
        StructField("id", LongType()),
        StructField("row", IntegerType()),
        StructField("start", IntegerType()),
        StructField("windows", IntegerType()),
        StructField("anchor", LongType()),
        StructField("context", LongType()),
    ]
)


def _columns(part: pa.RecordBatch, counts: list[int], arrays: list[np.ndarray], schema: StructType) -> pa.RecordBatch:
    at = pa.array(np.repeat(np.arange(part.num_rows), counts))
    kinds = {IntegerType(): np.int32, LongType(): np.int64}
    made = [
        pa.array(a.view(np.int64) if a.dtype == np.uint64 else a.astype(kinds[f.dataType]))
        for a, f in zip(arrays, schema.fields[2:], strict=True)
    ]
    return pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), *made], names=schema.names)


def _segment_rows(window: int, gram: int):
    def start():
        def work(part: pa.RecordBatch, texts: Texts):
            found = [segments((t or b"").split(), window, gram) for t in texts]
            if not any(f is not None for f in found):
                return None
            counts = [0 if f is None else len(f[0]) for f in found]
            arrays = [np.concatenate([f[k] for f in found if f is not None]) for k in range(4)]
            return _columns(part, counts, arrays, SEGMENT)

        return work

    return start


WINDOW = StructType(
    [
        StructField("id", LongType()),
        StructField("row", IntegerType()),
        StructField("start", IntegerType()),
        StructField("anchor", LongType()),
        StructField("window", LongType()),
    ]
)


def _window_rows(window: int):
    def start():
        def work(part: pa.RecordBatch, texts: Texts):
            counts, starts, anchors, windows = [], [], [], []
            for text, wanted in zip(texts, part.column(3).to_pylist(), strict=True):
                runs = runs_of_words((text or b"").split())
                each = [np.arange(w["start"], w["start"] + w["windows"]) for w in wanted]
                at = np.concatenate(each)
                counts.append(len(at))
                starts.append(at)
                anchors.append(np.repeat(np.array([w["anchor"] for w in wanted], np.int64), [len(e) for e in each]))
                windows.append(run_hash(runs, at, window))
            if not counts:
                return None
            return _columns(part, counts, [np.concatenate(x) for x in (starts, anchors, windows)], WINDOW)

        return work

    return start


def _cut(window: int, with_text: bool):
    def start():
        def work(texts: Texts, cuts: list):
            n_words, n_removed, digests, kept_texts = [], [], [], []
            for text, cut in zip(texts, cuts, strict=True):
                words = (text or b"").split()
                gone = np.zeros(len(words) + 1, np.int64)
                for c in cut or ():
                    gone[c["start"]] += 1
                    gone[c["start"] + c["windows"] + window - 1] -= 1
                gone = np.cumsum(gone)[:-1] > 0
                kept = b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]) if cut else b" ".join(words)
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                digests.append(hashlib.sha256(kept).hexdigest())
                kept_texts.append(kept.decode() if with_text else None)
            return n_words, n_removed, digests, kept_texts

        return work

    return start


def repeats(keyed: DataFrame, window: int, gram: int = GRAM) -> DataFrame:
    """(id, row, start, windows): windows that also occur in a row with a smaller id.

    ``keyed`` has id, row (a hash that tells rows of one id apart) and text.
    """
    of_kind = lambda schema: StructType([keyed.schema["id"], *schema.fields[1:]])
    all_segments = staged(explode_texts(keyed, "text", of_kind(SEGMENT), _segment_rows(window, gram)), "segments")
    # seeds: anchors that occur in two documents at least
    shared = all_segments.groupBy("anchor").agg(F.min("id").alias("least"), F.max("id").alias("most")).filter("least < most")
    seeds = staged(all_segments.join(own_shuffle(shared.select("anchor")), "anchor", "left_semi"), "seeds")
    # extension: the first document of each whole context, and how many contexts an anchor has
    contexts = staged(seeds.groupBy("anchor", "context").agg(F.min("id").alias("first"), F.max("id").alias("last")), "contexts")
    several = contexts.groupBy("anchor").agg(F.count("*").alias("contexts")).filter("contexts > 1")
    marked = contexts.join(own_shuffle(several), "anchor", "left").filter("first < last or contexts > 1")
    marked = staged(marked.select("anchor", "context", "first", (F.col("contexts") > 1).alias("open")), "marked")
    met = seeds.join(marked, ["anchor", "context"])
    whole = met.filter("id > first").select("id", "row", "start", "windows")
    unsettled = met.filter("id = first and open").select("id", "row", F.struct("start", "windows", "anchor").alias("segment"))
    wanted = staged(unsettled.groupBy("id", "row").agg(F.collect_list("segment").alias("segments")), "wanted")
    texts = keyed.join(wanted, ["id", "row"]).select("id", "row", "text", "segments")
    windows = staged(explode_texts(texts, "text", of_kind(WINDOW), _window_rows(window)), "settled")
    firsts = windows.groupBy("anchor", "window").agg(F.min("id").alias("first"), F.max("id").alias("last")).filter("first < last")
    firsts = staged(firsts.drop("last"), "firsts")
    single = windows.join(firsts, ["anchor", "window"]).filter("id > first").select("id", "row", "start", F.lit(1).alias("windows"))
    return whole.unionByName(single)


def remove_repeats(
    docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", window: int = 50, with_text: bool = False
) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256) for every row of ``docs``, and kept_text on demand:
    the words outside all removed windows, joined by one space."""
    text = F.col(f"`{text_col}`")
    key = F.col(f"`{id_col}`")
    whole_number = isinstance(docs.select(key).schema[0].dataType, IntegralType)
    keyed = docs.select((key.cast("bigint") if whole_number else key).alias("id"), F.hash(text).alias("row"), text.alias("text"))
    with discarding_stages(docs.sparkSession):
        found = repeats(keyed.filter(F.col("id").isNotNull()), window)
        cuts = found.groupBy("id", "row").agg(F.collect_list(F.struct("start", "windows")).alias("cuts"))
        cuts = staged(cuts, "cuts", keep=True)
    joined = keyed.join(cuts, ["id", "row"], "left")
    fields = [
        StructField("n_words", LongType()),
        StructField("n_removed", LongType()),
        StructField("kept_sha256", StringType()),
        StructField("kept_text", StringType()),
    ]
    result = extend(joined.select("id", "text", "cuts"), "text", fields, _cut(window, with_text), also=["cuts"])
    names = ["n_words", "n_removed", "kept_sha256", *(["kept_text"] if with_text else [])]
    return result.select(F.col("id").alias(id_col), *names)
