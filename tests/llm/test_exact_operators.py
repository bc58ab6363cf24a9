"""Operators whose result is fixed, against plain versions, on odd tables and the test tables."""

import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tablewright.llm import decontaminate, pii, queries, simhash, substrings
from tablewright.llm.components import connected
from tablewright.llm.statistics import COUNTS, counts

from . import brute
from .conftest import SF, rows_of


def pairs(spark, sf=SF):
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]


def by_id(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r))


# decontamination


def test_contamination_of_the_test_tables(spark):
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    found = rows_of(queries.op1_decontamination(spark, SF), "doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
    assert found == by_id(brute.contamination(pairs(spark), items)) and any(r[-1] for r in found)


def words(n, seed):
    picked = random.Random(seed)
    return [f"w{picked.randrange(30)}" for _ in range(n)]


@pytest.mark.parametrize("block", [1_000, 7])
def test_contamination_in_one_block_or_many(spark, documents, block):
    items = [(k, " ".join(words(5 + 4 * k, k))) for k in range(8)] + [(3, "w1 w2"), (None, "Only! Here"), (9, None), (10, "...")]
    docs = [(k, " ".join(words(40, 100 + k))) for k in range(6)]
    docs += [(20, "È, " + items[6][1].upper() + " - w1, W2 only here"), (21, items[7][1] + " " + items[7][1]), (22, None), (23, "w1 w2")]
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    found, names = decontaminate.find_contamination(documents(*docs), benchmark, block_windows=block)
    digest = F.sha2(F.array_join(names["items"], ","), 256)
    got = found.select("doc_id", names["n_words"], names["n_hit"], F.size(names["items"]), digest, names["contaminated"])
    want = brute.contamination(docs, [("null" if i is None else i, t) for i, t in items])
    assert by_id([tuple(r) for r in got.collect()]) == by_id(want)
    shown = {r["doc_id"]: r for r in found.collect()}
    text = dict(docs)[20]
    places = [text[s["start"] : s["end"]] for s in shown[20][names["spans"]]]
    assert places == [items[6][1].upper(), "w1, W2", "only here"]
    kept = decontaminate.drop_contaminated(documents(*docs), benchmark, block_windows=block)
    assert {r[0] for r in kept.select("doc_id").collect()} == {d[0] for d in want if not d[-1]}


def test_contamination_takes_odd_tables(spark, odd, empty):
    benchmark = spark.createDataFrame([(1, "word")], "item_id long, text string")
    none = benchmark.filter("false")
    kept = decontaminate.drop_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count() - 2
    assert kept.select("contaminated").distinct().collect()[0][0] == "mine"
    assert decontaminate.drop_contaminated(odd, none).count() == odd.count()
    assert decontaminate.drop_contaminated(empty, benchmark).count() == 0


# near-duplicates


def test_groups_of_the_test_tables(spark):
    found = rows_of(queries.op4_simhash(spark, SF), "doc_id", "fingerprint", "component_id")
    assert found == by_id(brute.groups(pairs(spark)))


def test_groups_of_odd_texts(spark, odd, empty):
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = simhash.near_duplicates(odd)
    assert rows_of(found, *found.columns) == by_id(brute.groups(texts))
    assert simhash.near_duplicates(empty).count() == 0


def test_one_document_of_each_group_stays(spark, odd):
    kept = simhash.one_per_group(odd)
    assert kept.columns == odd.columns
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    want = {d for d, _, first in brute.groups(texts) if d == first}
    assert sorted((r["doc_id"] for r in kept.select("doc_id").collect()), key=str) == sorted(want, key=str)
    assert kept.select("fingerprint").distinct().collect()[0][0] == "mine"


def test_an_id_with_two_texts_is_two_documents(documents):
    a, b = "one two three four five", "six seven eight nine ten eleven"
    kept = simhash.one_per_group(documents((1, a), (1, b), (2, b), (None, a), (None, "twelve thirteen")))
    assert sorted(r["text"] for r in kept.collect()) == sorted([a, b, "twelve thirteen"])


def test_components_of_chains_stars_and_rings(spark):
    edges = [(k, k + 1) for k in range(100, 160)] + [(k, 1) for k in range(2, 60)] + [(201, 202), (202, 203), (203, 201), (300, 300), (None, 4)]
    shuffled = random.Random(5).sample(edges, len(edges))
    found = connected(spark.createDataFrame(shuffled, "a long, b long"), "a", "b").collect()
    want = {k: 100 for k in range(100, 161)} | {k: 1 for k in range(1, 60)} | {k: 201 for k in (201, 202, 203)}
    assert {r["node"]: r["root"] for r in found} == want and len(found) == len(want)


# substrings


def test_repeats_of_the_test_tables(spark):
    found = rows_of(queries.op5_substrings(spark, SF), "doc_id", "n_words", "n_removed", "kept_sha256")
    assert found == by_id(brute.removed(pairs(spark))) and any(r[2] for r in found)


def test_repeats_with_edits_overlaps_and_copies(spark, documents):
    picked = random.Random(11)
    fresh = lambda n: [f"{picked.randrange(10**6):x}" for _ in range(n)]
    base, other = fresh(300), fresh(120)
    edited = base.copy()
    for k in (10, 75, 140, 200, 251):
        edited[k] = "edit"
    docs = [
        (5, base), (3, other), (9, edited), (7, base), (8, fresh(30) + base[40:100] + fresh(5) + other[20:90]),
        (2, fresh(20) + base[90:141]), (11, ["same"] * 200), (12, ["same"] * 120), (13, base[:49]), (14, base[:50]),
        (None, base), (5, other), (5, base),
    ]
    docs = [(k, "\n ".join(w)) for k, w in docs] + [(20, None), (21, ""), (22, " ")]
    found = rows_of(substrings.remove_repeats(documents(*docs), with_text=True), "doc_id", "n_words", "n_removed", "kept_sha256", "kept_text")
    assert [r[:4] for r in found] == by_id(brute.removed(docs))
    assert all(hashlib.sha256(r[4].encode()).hexdigest() == r[3] for r in found)


@pytest.mark.parametrize("kind", ["string", "decimal(30,0)", "int", "date"])
def test_substrings_of_any_id(spark, kind):
    """Ids beyond bigint and of other types, in their own order."""
    common = " ".join(words(70, 9))
    texts = {k: f"{' '.join(words(30, 50 + k))} {common} {' '.join(words(20, 80 + k))}" for k in range(12)}
    df = spark.createDataFrame(list(texts.items()), "k int, text string")
    ids = {
        "string": F.concat(F.lit("doc-"), "k"),
        "decimal(30,0)": F.col("k").cast("decimal(30,0)") + F.lit("100000000000000000000").cast("decimal(30,0)"),
        "int": F.col("k"),
        "date": F.date_add(F.lit("2026-01-01"), F.col("k")),
    }
    df = df.select(ids[kind].alias("doc_id"), "text")
    found = [tuple(r) for r in substrings.remove_repeats(df).collect()]
    want = brute.removed([tuple(r) for r in df.collect()])
    assert sorted(found) == sorted(want) and sum(r[2] for r in want) >= 11 * 70


def test_repeats_take_odd_tables(odd, empty):
    texts = [(r["doc_id"], r["text"]) for r in odd.select("doc_id", "text").collect()]
    found = substrings.remove_repeats(odd)
    lengths = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in found.collect()}
    assert found.count() == len(texts) and lengths[7] == (180_000, 0)
    assert substrings.remove_repeats(empty).count() == 0


# personal data


TEXTS = [
    "mail a.b+c@x.example.com, @nobody, a@b, x@y.z@w.v, .@-.-",
    "ips 1.2.3.4 01.002.255.0 256.1.1.1 1.2.3.4.5.6.7.8 9.9.9 " + "9" * 5000 + ".1.1.1",
    "cards 4111 1111 1111 1111, 4111-1111-1111-1112 4012888888881881 1 2  3",
    "phones +1 (988) 555-2485 +44 20 7946 0958. +12 +1-2 +123456789012345678 ++4912345678901",
    "iban DE89 3704 0044 0532 0130 00 and GB82WEST12345698765432, not DE89370400440532013001",
    "ssn 078-05-1120 social security; 219-09-9999",
]


@pytest.mark.parametrize("text", TEXTS)
def test_spans_are_those_of_the_patterns(text):
    base = [s[:3] for s in pii.find(text) if s.kind in pii.BASE_KINDS]
    assert base == brute.spans(text)


@settings(max_examples=300, deadline=None)
@given(st.text("0123456789.+-() @ab%", max_size=60))
def test_spans_of_any_text(text):
    assert [s[:3] for s in pii.find(text) if s.kind in pii.BASE_KINDS] == brute.spans(text)


def test_added_kinds_need_a_check_and_context():
    assert [s.kind for s in pii.find(TEXTS[4]) if s.kind not in pii.BASE_KINDS] == ["iban", "iban"]
    assert [s.kind for s in pii.find("my ssn is 219-09-9999") if s.kind not in pii.BASE_KINDS] == ["ssn"]
    assert not pii.find("order 219-09-9999")
    assert pii.find("email me: a@b.cd")[0].score >= pii.find("a@b.cd")[0].score


@pytest.mark.parametrize("iban", ["HR12 1001 0051 8630 0016 0", "SK31 1200 0000 1987 4263 7541", "MT84MALT011000012345MTLCAST001S", "TR330006100519786457841326", "AE070331234567890123456", "SI56263300012039086"])
def test_ibans_of_the_whole_registry(iban):
    assert [(s.kind, s.start, s.end) for s in pii.find(f"pay {iban}.") if s.kind == "iban"] == [("iban", 4, 4 + len(iban))]


def test_context_after_a_span():
    assert [s.kind for s in pii.find("123-45-6789 is my SSN") if s.kind == "ssn"] == ["ssn"]


def test_spans_of_the_test_tables(spark):
    found = rows_of(queries.op9_pii(spark, SF), "doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256")
    want = []
    for doc, text in pairs(spark):
        base = brute.spans(text)
        digest = hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
        want.append((doc, *[sum(s[0] == k for s in base) for k in pii.BASE_KINDS], digest))
    assert found == by_id(want)


def test_redaction(spark, odd, empty):
    docs = spark.createDataFrame([(1, "é a@b.cd 1.2.3.4!", 17), (2, "clean", 99), (3, None, None)], "doc_id long, text string, n_chars int")
    found = rows_of(pii.redact(docs), "doc_id", "text", "n_chars")
    assert found == [(1, "é [EMAIL] [IP]!", 15), (2, "clean", 99), (3, None, None)]
    assert pii.redacted("abcdef", [pii.Span("ip", 1, 4, 1), pii.Span("card", 2, 5, 1)]) == "a[IP]f"
    assert rows_of(pii.redact(odd), "doc_id", "text") == rows_of(odd, "doc_id", "text")
    assert pii.redact(empty).count() == 0 and pii.redact(odd).columns == odd.columns


def test_patterns_walk_hostile_text_once():
    for text in ("a" * 300_000, "1" * 300_000, "1." * 150_000, "a@" * 150_000, "+1" * 150_000, "a.b-" * 80_000 + "@", "AA11" * 80_000):
        pii.find(text)


# statistics


@settings(max_examples=200, deadline=None)
@given(st.text("ab \n\t#|é", max_size=60))
def test_statistics_of_any_text(text):
    found = dict(zip(COUNTS, counts(text.encode()), strict=True))
    assert tuple(found[n] for n in COUNTS[:5]) == brute.statistics(text)


def test_statistics_of_the_test_tables(spark):
    found = rows_of(queries.op7_rules(spark, SF), "doc_id", *COUNTS[:5], "base_failed")
    want = []
    for doc, text in pairs(spark):
        n = brute.statistics(text)
        want.append((doc, *n, n[0] < 50 or 100 * n[4] > 50 * n[0]))
    assert found == by_id(want)
