"""Packing of tokenised documents into sequences of a fixed length: online sum of squares.

A document's ids are those of a public tokenizer and one end id. Whole sequences are cut from
the front of a long document; the rest is an item for the packer. Of all open sequences the
packer knows only a *level array*: how many are filled to each level. An item goes to the level
where the sum of the squared counts becomes smallest (Csirik et al., "On the sum-of-squares
algorithm for bin packing", 2006): levels that are already common are not made more common, so
every remainder soon finds a partner that fills its sequence.

What is still open at the end of a partition (or when ``OPEN`` sequences are) is closed by
cutting the pieces of the emptiest ones into the gaps of the fullest, which leaves at most one
sequence with padding.

At scale: partitions of the input are packed on their own, without a shuffle; each loses less
than one sequence to padding. A partition holds the ids of one document and of the open
sequences. Sequence numbers contain the partition's, so a lost task makes the same rows again.

Defined results: null or empty text is the end id alone. Repeated rows are packed like any
others. An empty table gives no rows.
"""

from __future__ import annotations

import json
import os
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, LongType, StructField, StructType

from .batches import SLICE, once

LENGTH = 2048
END = 1
TOKENIZER = "byte_bpe_50k.json"
#: Open sequences a packer holds before it closes them.
OPEN = 2048


class Encoder:
    """Ids of a text as bytes of 32-bit numbers, as the tokenizer file says.

    A byte-level BPE whose merges are in the order of its ids, with the usual splitting pattern, is
    run by ``tiktoken``, several times faster and with the same ids; anything else, and text that
    contains a special token, by ``tokenizers``.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self._tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            config = json.load(f)
        self._special = [t["content"] for t in config.get("added_tokens", ())]
        self._fast = _same_by_ranks(config)

    def ids(self, text: str) -> bytes:
        if self._fast is not None and not any(t in text for t in self._special):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4").tobytes()
            except ValueError:  # white space by the million is too deep for its pattern
                pass
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def _same_by_ranks(config: dict):
    """The tokenizer as ranks of byte strings, or None if that might give other ids."""
    model, before = config["model"], config.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not config.get("normalizer") and not any(
        model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback")
    )
    plain = plain and before.get("type") == "ByteLevel" and not before.get("add_prefix_space") and before.get("use_regex", True)
    if not plain:
        return None
    vocabulary = model["vocab"]
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    made = [vocabulary[m] for m in merged]
    special = {t["content"] for t in config.get("added_tokens", ())}
    if made != sorted(made) or len(made) + 256 != len(vocabulary.keys() - special):
        return None
    import public_tokenizers
    import tiktoken

    letters = _byte_letters()
    ranks = {bytes(letters[c] for c in token): k for token, k in vocabulary.items() if token not in special}
    return tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def _byte_letters() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the others, in order, as
    the letters from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(others)}


class Packer:
    """Items to sequences. Places are (key, start, ids, total): a piece of a document's ids."""

    def __init__(self, length: int = LENGTH, open_most: int = OPEN):
        self.length, self.open_most = length, open_most
        self.counts = np.zeros(length + 1, np.int64)  # open sequences at each level
        self.at_level: dict[int, list[list]] = defaultdict(list)
        self.open = 0

    def level_for(self, size: int) -> int:
        """The level to fill (0: a new sequence) that makes the sum of squares smallest; of
        equal ones the fullest."""
        counts, length = self.counts, self.length
        if size == length:
            return 0
        change = 2 * (counts[size:length] - counts[: length - size]) + 2
        change[counts[: length - size] == 0] = np.iinfo(np.int64).max
        change[0] = 2 * counts[size] + 1
        best = len(change) - 1 - int(change[::-1].argmin())
        full = counts[length - size]
        return length - size if full and 1 - 2 * full <= change[best] else best

    def add(self, key, start: int, ids: bytes, total: int) -> Iterator[list]:
        """Place one item; yields sequences that are complete."""
        size = len(ids) // 4
        level = self.level_for(size)
        pieces = self.at_level[level].pop() if level else []
        if level:
            self.counts[level] -= 1
            self.open -= 1
        pieces.append((key, start, ids, total))
        level += size
        if level == self.length:
            yield pieces
            return
        self.at_level[level].append(pieces)
        self.counts[level] += 1
        self.open += 1
        if self.open >= self.open_most:
            yield from self.close()

    def close(self) -> Iterator[list]:
        """All open sequences, the gaps of the fullest filled with pieces of the emptiest."""
        waiting = [pieces for level in sorted(self.at_level, reverse=True) for pieces in self.at_level[level]]
        self.at_level.clear()
        self.counts[:] = 0
        self.open = 0
        loose: list[tuple] = []
        first, last = 0, len(waiting) - 1
        while first <= last or loose:
            pieces = waiting[first] if first <= last else []
            first += 1
            gap = self.length - sum(len(p[2]) for p in pieces) // 4
            while gap and (loose or first <= last):
                if not loose:
                    loose.extend(waiting[last])
                    last -= 1
                key, start, ids, total = loose.pop()
                pieces.append((key, start, ids[: 4 * gap], total))
                if len(ids) > 4 * gap:
                    loose.append((key, start + gap, ids[4 * gap :], total))
                gap = self.length - sum(len(p[2]) for p in pieces) // 4
            yield pieces


PIECES = [
    StructField("start", LongType()),
    StructField("length", LongType()),
    StructField("ids_crc32", LongType()),
    StructField("doc_tokens", LongType()),
    StructField("sequence_id", LongType()),
    StructField("offset", LongType()),
    StructField("ids", BinaryType()),
]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def pack(
    docs: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: int = LENGTH,
    end_id: int = END,
    tokenizer: str | None = None,
    with_ids: bool = False,
) -> DataFrame:
    """One row for each piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset,
    and on demand ids (little-endian 32-bit numbers). ``tokenizer`` is a file that every
    executor has."""
    path = tokenizer or default_tokenizer()
    bare = docs.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    schema = StructType([StructField(id_col, bare.schema["id"].dataType), *(PIECES if with_ids else PIECES[:-1])])
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer = once(f"tokenizer:{path}", lambda: Encoder(path)), Packer(length)
        number, kind = TaskContext.get().partitionId() << 40, None

        def table(sequences: list[list]) -> pa.RecordBatch:
            nonlocal number
            columns: list[list] = [[] for _ in schema.fields]
            for pieces in sequences:
                at = 0
                for key, start, ids, total in pieces:
                    size = len(ids) // 4
                    for column, value in zip(columns, (key, start, size, zlib.crc32(ids), total, number, at, ids), strict=False):
                        column.append(value)
                    at += size
                number += 1
            types = [kind, *[pa.int64()] * 6, pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=False)], names=schema.names)

        for batch in batches:
            kind = batch.column(0).type
            for begin in range(0, batch.num_rows, SLICE):
                part, done = batch.slice(begin, SLICE), []
                for key, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    ids = encoder.ids(text or "") + end
                    total = len(ids) // 4
                    whole = total - total % length
                    done += [[(key, k, ids[4 * k : 4 * (k + length)], total)] for k in range(0, whole, length)]
                    if whole < total:
                        done += packer.add(key, whole, ids[4 * whole :], total)
                if done:
                    yield table(done)
        rest = list(packer.close())
        if rest:
            yield table(rest)

    return bare.mapInArrow(run, schema)
