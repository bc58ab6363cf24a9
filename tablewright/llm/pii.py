"""Personal data: patterns propose spans, checks confirm them, context words adjust the score.

Base kinds are email, ip, card and phone; a proposal that fails its check (parts up to 255,
Luhn, number of digits) is dropped and not tried otherwise. Their score is high by itself. Further
kinds are spans whose form alone is weak: iban (length by country, mod 97) and ssn (areas in
use). A context word near a span, before or after it, raises its score, and what stays under the threshold
is not reported.

Patterns are written so that each is scanned in time proportional to the text, whatever the
text: no pattern starts anew inside a run that it has walked already.

At scale: one pass over the rows, no shuffle, nothing kept between rows.

Defined results: null text is empty. Spans are counted in characters (code points), the end
excluded; kinds may overlap. Redaction replaces what overlaps by one mark.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField

from .batches import Texts, extend, hidden

BASE_KINDS = ("email", "ip", "card", "phone")
ADDED_KINDS = ("iban", "ssn")
KINDS = BASE_KINDS + ADDED_KINDS

#: An address's domain, from its sign on; what stands before the sign is walked backwards.
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?=[ A-Z0-9])")
SSN = re.compile(r"(?<![0-9-])([0-9]{3})-([0-9]{2})-([0-9]{4})(?![0-9-])")

#: The length of an IBAN by country (ISO 13616).
_REGISTRY = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 "
    "EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HN28 HR21 HU28 IE22 IL23 IQ23 IS26 "
    "IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 "
    "NL18 NO15 OM23 PK24 PL28 PS29 PT25 QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 "
    "SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30"
)
IBAN_LENGTHS = {entry[:2]: int(entry[2:]) for entry in _REGISTRY.split()}

#: Words that speak for a kind when they stand near a span, on either side.
CONTEXT = {
    "email": ("mail", "contact", "write", "correo", "courriel"),
    "ip": ("ip", "address", "host", "server"),
    "card": ("card", "visa", "credit", "payment", "karte", "tarjeta", "carte"),
    "phone": ("phone", "call", "tel", "mobile", "telefon", "teléfono", "téléphone"),
    "iban": ("iban", "account", "bank", "konto", "cuenta", "compte"),
    "ssn": ("ssn", "social", "security", "taxpayer"),
}
CONTEXT_CHARS = 60
WORD = re.compile(r"\w+")

#: Score of a checked span without context, what a context word adds, and the least reported.
SCORE = {"email": 0.9, "ip": 0.7, "card": 0.8, "phone": 0.7, "iban": 0.8, "ssn": 0.4}
RAISE = 0.2
LEAST = 0.6


class Span(NamedTuple):
    kind: str
    start: int
    end: int
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        value = int(d) * (1 + k % 2)
        total += value - 9 * (value > 9)
    return total % 10 == 0


def mod97(iban: str) -> bool:
    turned = iban[4:] + iban[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def _digits(text: str) -> str:
    return "".join(c for c in text if c in "0123456789")


def emails(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in DOMAIN.finditer(text):
        start = m.start()
        while start > done and LOCAL.match(text[start - 1]):
            start -= 1
        if start < m.start():
            yield start, m.end()
            done = m.end()


def ips(text: str) -> Iterator[tuple[int, int]]:
    for m in IP.finditer(text):
        parts = [p.lstrip("0") or "0" for p in m.group().split(".")]
        if all(len(p) <= 3 and int(p) <= 255 for p in parts):
            yield m.span()


def cards(text: str) -> Iterator[tuple[int, int]]:
    for m in CARD.finditer(text):
        digits = _digits(m.group())
        if 13 <= len(digits) <= 19 and luhn(digits):
            yield m.span()


def phones(text: str) -> Iterator[tuple[int, int]]:
    for m in PHONE.finditer(text):
        if 9 <= len(_digits(m.group())) <= 15:
            yield m.span()


def ibans(text: str) -> Iterator[tuple[int, int]]:
    done = 0
    for m in IBAN.finditer(text):
        length = IBAN_LENGTHS.get(m.group()[:2])
        if length is None or m.start() < done:
            continue
        found, at = [], m.start()
        while at < len(text) and len(found) < length and (text[at] in "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789" or text[at] == " " and text[at - 1] != " "):
            found += text[at] if text[at] != " " else ""
            at += 1
        ends = at == len(text) or not (text[at].isascii() and text[at].isalnum())
        if len(found) == length and ends and mod97("".join(found)):
            yield m.start(), at
            done = at


def ssns(text: str) -> Iterator[tuple[int, int]]:
    for m in SSN.finditer(text):
        area, group, serial = m.groups()
        if area not in ("000", "666") and area < "900" and group != "00" and serial != "0000":
            yield m.span()


FINDERS = {"email": emails, "ip": ips, "card": cards, "phone": phones, "iban": ibans, "ssn": ssns}


def find(text: str | None) -> list[Span]:
    """All reported spans, by kind as listed, then by start."""
    found = []
    for kind in KINDS:
        for start, end in FINDERS[kind](text or ""):
            around = text[max(0, start - CONTEXT_CHARS) : start], text[end : end + CONTEXT_CHARS]
            near = any(w in CONTEXT[kind] for side in around for w in WORD.findall(side.lower()))
            score = min(1.0, SCORE[kind] + RAISE * near)
            if kind in BASE_KINDS or score >= LEAST:
                found.append(Span(kind, start, end, score))
    return found


def listed(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in spans)


def redacted(text: str, spans: list[Span]) -> str:
    """The text with every run of overlapping spans replaced by the mark of its first kind."""
    parts, done = [], 0
    last_end = -1
    for s in sorted(spans, key=lambda s: (s.start, -s.end)):
        if s.start < last_end:
            last_end = max(last_end, s.end)
            done = last_end
            continue
        parts += [text[done : s.start], f"[{s.kind.upper()}]"]
        done = last_end = s.end
    return "".join([*parts, text[done:]])


def detect(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with counts of the base kinds, a digest of the base spans, and all spans as text
    and with scores; and the names the new columns got."""
    wanted = [*(f"n_{k}" for k in BASE_KINDS), "base_sha256", "spans", "scores"]
    names = dict(zip(wanted, hidden(docs, *wanted), strict=True))
    kinds = [LongType()] * 4 + [StringType()] * 3
    fields = [StructField(n, k) for n, k in zip(names.values(), kinds, strict=True)]

    def start():
        def work(texts: Texts):
            columns: list[list] = [[] for _ in fields]
            for text in texts:
                spans = find(text.decode()) if text else []
                base = [s for s in spans if s.kind in BASE_KINDS]
                row = [sum(s.kind == k for s in base) for k in BASE_KINDS]
                row += [hashlib.sha256(listed(base).encode()).hexdigest(), listed(spans)]
                row.append(",".join(f"{s.score:.1f}" for s in spans))
                for column, value in zip(columns, row, strict=True):
                    column.append(value)
            return columns

        return work

    return extend(docs, text_col, fields, start), names


def redact(docs: DataFrame, *, text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The documents, personal data in their text replaced by marks like ``[EMAIL]``.

    Texts without any stay as they are. ``chars_col``, where there is one, follows a changed text.
    """
    [new] = hidden(docs, "redacted")

    def start():
        def work(texts: Texts):
            done = []
            for text in texts:
                plain = None if text is None else text.decode()
                spans = find(plain) if plain else []
                done.append(redacted(plain, spans) if spans else None)
            return (done,)

        return work

    found = extend(docs, text_col, [StructField(new, StringType())], start)
    changed, columns = F.col(new).isNotNull(), []
    for name in docs.columns:
        column = F.col(f"`{name}`")
        if name == text_col:
            column = F.coalesce(F.col(new), column)
        elif name == chars_col:
            column = F.when(changed, F.length(new).cast(docs.schema[name].dataType)).otherwise(column)
        columns.append(column.alias(name))
    return found.select(*columns)
