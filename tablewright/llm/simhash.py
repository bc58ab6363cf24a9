"""SimHash near-duplicates by multi-index hashing.

A fingerprint has 64 bits; a bit is set if it is set in over half the hashes of the text's
word shingles. Two fingerprints link if they differ in two bits or fewer, and a group is what
links reach.

The links are found by :mod:`.multi_index`: hash tables by segment, small Hamming balls, complete
distances. Exact copies share a fingerprint and are one row before any of this.

Defined results
---------------
Null, empty or blank text: fingerprint zero, linked like any other. Rows with a null id get
the smallest id of their group as well, null if the group has none. Repeated rows are kept.
"""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField

from ..scratch import discarding_stages, staged
from .batches import Texts, extend, hidden
from .components import connected
from .multi_index import near_pairs

SEED = 42
BITS = 64
MOST_BITS = 2
#: Hashes whose bits are counted at once; bounds memory for very long texts.
BLOCK = 1 << 15


def fingerprint(text: bytes | None, n: int = 3) -> int:
    """The fingerprint of one text, as a signed 64-bit number."""
    words = (text or b"").lower().split()
    if not words:
        return 0
    digest = xxhash.xxh64_intdigest
    whole = b" ".join(words)
    if len(words) <= n:
        hashes = [digest(whole, SEED)]
    else:
        ends = list(accumulate(len(w) + 1 for w in words))
        starts = [0, *ends[: len(words) - n]]
        hashes = [digest(whole[a : b - 1], SEED) for a, b in zip(starts, ends[n - 1 :], strict=True)]
    counts = np.zeros(BITS, np.int64)
    for k in range(0, len(hashes), BLOCK):
        part = np.array(hashes[k : k + BLOCK], "<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view("<i8")[0])


def with_fingerprint(df: DataFrame, text_col: str, name: str, n: int = 3) -> DataFrame:
    def start():
        def work(texts: Texts):
            return ([fingerprint(t, n) for t in texts],)

        return work

    return extend(df, text_col, [StructField(name, LongType())], start)


def group_ids(fingerprints: DataFrame, id_cols: list[str]) -> DataFrame:
    """(fingerprint, first): for every fingerprint the smallest id of its group.

    ``fingerprints`` has the id columns and ``fingerprint``; ids order by the columns in turn.
    """
    with discarding_stages(fingerprints.sparkSession):
        each = staged(fingerprints.groupBy("fingerprint").agg(F.min(F.struct(*id_cols)).alias("first")), "fingerprints")
        roots = staged(connected(near_pairs(each, "fingerprint", MOST_BITS), "a", "b"), "roots")
        linked = each.join(roots, F.col("node") == F.col("fingerprint"))
        first = staged(linked.groupBy("root").agg(F.min("first").alias("group_first")), "firsts")
        known = roots.join(first, "root").select("node", "group_first")
        joined = each.join(known, F.col("node") == F.col("fingerprint"), "left")
        return staged(joined.select("fingerprint", F.coalesce("group_first", "first").alias("first")), "groups", keep=True)


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """(id, fingerprint, component_id) for every row: 16 hex digits, and the smallest id that
    links reach."""
    bare = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").alias("text"))
    with discarding_stages(docs.sparkSession):
        prints = staged(with_fingerprint(bare, "text", "fingerprint", n).select("id", "fingerprint"), "simhash")
        groups = group_ids(prints.select(F.col("id").isNull().alias("none"), "id", "fingerprint"), ["none", "id"])
        found = prints.join(groups, "fingerprint")
        digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
        found = found.select(F.col("id").alias(id_col), digits.alias("fingerprint"), F.col("first.id").alias("component_id"))
        return staged(found, "answer", keep=True)


def one_per_group(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", n: int = 3) -> DataFrame:
    """The document with the smallest id of every group, all its columns as they were.

    A row is told by its id and a hash of its text, so a repeated id is no harm; rows alike in
    both are copies, of which one stays. A row without an id stays only if its whole group has
    none.
    """
    key_id, key_text = F.col(f"`{id_col}`"), F.xxhash64(F.col(f"`{text_col}`"))
    bare = docs.select(key_id.alias("id"), key_text.alias("hash"), F.col(f"`{text_col}`").alias("text"))
    with discarding_stages(docs.sparkSession):
        prints = staged(with_fingerprint(bare, "text", "fingerprint", n).select("id", "hash", "fingerprint"), "simhash")
        told = prints.select(F.col("id").isNull().alias("none"), "id", "hash", "fingerprint")
        first = group_ids(told, ["none", "id", "hash"]).select("first").distinct().select("first.id", "first.hash")
        copies = prints.groupBy("id", "hash").agg(F.count("*").alias("copies"))
        same = F.col("id").eqNullSafe(F.col("other_id")) & (F.col("hash") == F.col("other_hash"))
        kept = first.join(copies.withColumnsRenamed({"id": "other_id", "hash": "other_hash"}), same)
        kept_id, kept_hash, copies_of, own_hash = hidden(docs, "kept_id", "kept_hash", "copies", "hash")
        kept = kept.select(F.col("id").alias(kept_id), F.col("hash").alias(kept_hash), F.col("copies").alias(copies_of))
        kept = staged(kept, "kept", keep=True)
    match = key_id.eqNullSafe(F.col(kept_id)) & (key_text == F.col(kept_hash))
    single = docs.join(kept.filter(F.col(copies_of) == 1), match, "left_semi")
    several = docs.join(kept.filter(F.col(copies_of) > 1), match, "left_semi").withColumn(own_hash, key_text)
    return single.unionByName(several.dropDuplicates([id_col, own_hash]).drop(own_hash))
