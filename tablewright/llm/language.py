"""Language identification by compression.

For every language a raw-content zstandard dictionary is made from a bounded sample of labelled
text. A text is encoded with each dictionary; the language whose dictionary makes it smallest
wins, and the decision is rejected when the runner-up is nearly as small.

Texts are first reduced to lower-case letters and single spaces, so that capitals, numbers and
symbols say nothing. Whole texts are encoded, in pieces of a fixed size: what a long text has
repeated before would otherwise outweigh the dictionary.

At scale: fitting hashes the labelled texts in one pass, takes ``SAMPLE`` different ones a language,
and sends ``PIECE_BYTES`` of each to the driver, all of which go into the dictionary. Predicting is one
pass without a shuffle; what is broadcast is one dictionary of at most ``DICTIONARY`` bytes for each of
at most ``MOST_LANGUAGES`` languages, the most common ones among the labels.

Defined results: null text or text without a letter is ``und`` with score 0, rejected. With no
labelled text at all everything is ``und``. Equal sizes go to the language more common among the
labels (then the lesser name), and are rejected.
"""

from __future__ import annotations

import re
import uuid
from dataclasses import dataclass, field

import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField

from ..scratch import discarding_stages, staged
from .batches import Texts, extend, hidden, held_out, once

UNKNOWN = "und"
#: Different labelled texts a language that a dictionary is made from, and its bytes.
SAMPLE = 200
DICTIONARY = 128 * 1024
#: Bytes of each; a piece has that many characters or fewer.
PIECE_BYTES = DICTIONARY // SAMPLE - 1
MOST_LANGUAGES = 100
#: zstandard's level, and bytes encoded at once.
LEVEL = 6
PIECE = 2_000
#: Least margin (1 - smallest / second smallest size) at which a decision is kept.
MARGIN = 0.005

NO_LETTERS = re.compile(r"[\W\d_]+")


def letters(text: str) -> bytes:
    return NO_LETTERS.sub(" ", text.lower()).strip().encode()


@dataclass
class Languages:
    """What was learned: for each language, most common first, its dictionary's content."""

    names: list[str]
    contents: list[bytes]
    token: str = field(default_factory=lambda: f"languages:{uuid.uuid4().hex}")

    def encoders(self) -> list[zstandard.ZstdCompressor]:
        found = []
        for content in self.contents:
            words = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            words.precompute_compress(LEVEL)
            found.append(
                zstandard.ZstdCompressor(
                    level=LEVEL, dict_data=words, write_checksum=False, write_content_size=False, write_dict_id=False
                )
            )
        return found


def fit(docs: DataFrame, learn_from: Column, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Languages:
    """Dictionaries from labelled documents for which ``learn_from`` holds."""
    key, text, lang = F.col(f"`{id_col}`"), F.col(f"`{text_col}`"), F.col(f"`{lang_col}`")
    usable = docs.filter(learn_from & lang.isNotNull() & text.rlike(r"\p{L}"))
    order = F.xxhash64(text)
    with discarding_stages(docs.sparkSession):
        # copies of a text are one; the least id stands for it
        texts = usable.groupBy(lang.alias("lang"), order.alias("hash")).agg(F.min(key).alias("id"), F.count("*").alias("n"))
        texts = staged(texts, "texts")
        common = texts.groupBy("lang").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LANGUAGES)
        counts = {r["lang"]: r["n"] for r in staged(common, "languages").collect()}
        newest = Window.partitionBy("lang").orderBy("hash", "id")
        picked = texts.filter(F.col("lang").isin(list(counts))).withColumn("k", F.row_number().over(newest)).filter(F.col("k") <= SAMPLE)
        # written first: its size, of SAMPLE ids a language, is known then, and no text is shuffled to meet it
        picked = staged(picked.select(F.col("lang").alias("__lang"), F.col("id").alias("__id"), F.col("hash").alias("__hash"), "k"), "picked")
        at = F.pmod(order, F.greatest(F.length(text) - PIECE_BYTES, F.lit(0)) + 1) + 1
        piece = F.substring(text, at.cast("int"), F.lit(PIECE_BYTES))
        rows = usable.join(picked, (key == F.col("__id")) & (lang == F.col("__lang")) & (order == F.col("__hash")))
        rows = rows.groupBy(F.col("__lang").alias("lang"), "k").agg(F.min(piece).alias("piece")).collect()
    names = sorted(counts, key=lambda name: (-counts[name], name))
    pieces = {(r["lang"], r["k"]): letters(r["piece"])[:PIECE_BYTES] for r in rows}
    contents = [b"\n".join(dict.fromkeys(pieces[at] for at in sorted(pieces) if at[0] == name)) or b" " for name in names]
    return Languages(names, contents)


def sizes(text: str, encoders: list[zstandard.ZstdCompressor]) -> list[int] | None:
    """Bytes the text takes with each dictionary; None if it has no letter."""
    plain = letters(text)
    if not plain:
        return None
    pieces = [plain[k : k + PIECE] for k in range(0, len(plain), PIECE)]
    return [sum([len(e.compress(p)) for p in pieces]) for e in encoders]


def predict(docs: DataFrame, languages: Languages, *, text_col: str = "text", margin: float = MARGIN) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the prediction, and the names its new columns got: lang_pred, score (how
    much larger the runner-up is, from 0 for as large to 1), accepted."""
    spark = docs.sparkSession
    names = dict(zip(("lang_pred", "score", "accepted"), hidden(docs, "lang_pred", "score", "accepted"), strict=True))
    [lettered] = hidden(docs, "lettered")
    fields = [StructField(n, k) for n, k in zip(names.values(), (StringType(), DoubleType(), BooleanType()), strict=True)]
    sent = spark.sparkContext.broadcast(languages)

    def start():
        known = sent.value
        encoders = once(known.token, known.encoders)

        def work(texts: Texts, has_letter: list):
            langs, scores, kept = [], [], []
            for text, letter in zip(texts, has_letter, strict=True):
                found = sizes(text.decode(), encoders) if letter and encoders else None
                if found is None:
                    langs.append(known.names[0] if letter and known.names else UNKNOWN)
                    scores.append(0.0)
                    kept.append(False)
                    continue
                best = min(range(len(found)), key=found.__getitem__)
                second = min((s for k, s in enumerate(found) if k != best), default=None)
                score = 1.0 if second is None else 1.0 - found[best] / second
                langs.append(known.names[best])
                scores.append(score)
                kept.append(score >= margin)
            return langs, scores, kept

        return work

    letter = F.coalesce(F.col(f"`{text_col}`").rlike(r"\p{L}"), F.lit(False))
    found = extend(docs.withColumn(lettered, letter), text_col, fields, start, also=[lettered])
    return found.drop(lettered), names


def keep_identified(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Fit on the documents' own labels outside fold 0, and drop what is rejected."""
    languages = fit(docs, ~held_out(id_col) & F.col(f"`{id_col}`").isNotNull(), id_col=id_col, text_col=text_col, lang_col=lang_col)
    found, names = predict(docs, languages, text_col=text_col)
    return found.filter(F.col(names["accepted"])).select(*[F.col(f"`{c}`") for c in docs.columns])
