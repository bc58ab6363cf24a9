"""Contractions against removing documents one by one."""

import re
from itertools import permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tablewright.llm import interactions, queries

from .conftest import SF

LABELS = "doc_id long, quality int, toxic int"


def plain(docs, labels):
    """[(id, text, part)], [(id, good, toxic)] -> {(part, order, step): results} by simulation."""
    good = {k for k, g, _ in labels if g == 1 and k is not None}
    toxic = {k for k, _, t in labels if t == 1 and k is not None}
    least = {}
    for key, text, _ in docs:
        if key is not None:
            least[text or ""] = min(key, least.get(text or "", key))
    failing = []
    for key, text, _ in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        tests = {
            "A": len(words) < 200,
            "B": 100 * len(set(words)) < 50 * len(words),
            "C": 100 * len(re.findall("[A-Z]", text)) > 3 * len(text),
            "D": bool(re.search(r"[#$%&*|]", text)),
            "E": key is not None and key > least[text],
        }
        failing.append({f for f, fails in tests.items() if fails})
    results = {}
    for part in {p or "" for _, _, p in docs}:
        here = [k for k, (_, _, p) in enumerate(docs) if (p or "") == part]
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = set(here)
            for step, f in enumerate(order, 1):
                gone = {k for k in left if f in failing[k]}
                earlier = [k for k in here if k not in left and f in failing[k]]
                left -= gone
                shapley[f] += len(gone)
                unique = sum(failing[k] == {f} for k in here)
                lost = [sum(docs[k][0] in of for k in gone) for of in (good, toxic)]
                results[part, "".join(order), step] = [len(left), len(gone), len(earlier), unique, *lost, f]
        for key, row in results.items():
            if key[0] == part:
                row[-1] = shapley[row[-1]]
    return results


def found_of(df):
    return {(r["part"], r["filter_order"], r["step"]): [r[c] for c in interactions.RESULTS] for r in df.collect()}


def test_query_of_the_test_tables(spark):
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    labels = [tuple(r) for r in spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality", "toxic").collect()]
    want = plain(docs, labels)
    assert found_of(queries.op12_filter_audit(spark, SF)) == want
    assert any(row[1] for row in want.values()) and any(row[2] for row in want.values())


def test_odd_tables(spark, odd, empty):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 1), (3, None, 1), (None, 1, 1), (7, 1, None), (7, 1, None)], LABELS)
    df = odd.withColumn("lang", F.when(F.col("doc_id") % 2 == 0, "x"))
    docs = [(r["doc_id"], r["text"], r["lang"]) for r in df.select("doc_id", "text", "lang").collect()]
    marks = [tuple(r) for r in labels.collect()]
    assert found_of(interactions.audit_filters(df, labels)) == plain(docs, marks)
    assert interactions.audit_filters(empty, labels).count() == 0
    assert found_of(interactions.audit_filters(df, labels.filter("false"))) == plain(docs, [])


def test_copies(spark):
    rows = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "a"), (None, "b"), (5, "b"), (4, "c")], "id long, hash string")
    found = [(r["id"], r["hash"], r["E"]) for r in interactions.with_copies(rows, "E").collect()]
    assert sorted((k for k, _, e in found if e), key=str) == [2] and len(found) == 7


def test_order_of_axes():
    tensor = np.zeros((2, 2, 3), np.int64)
    tensor[1, 0] = [10, 1, 0]  # fails the first only
    tensor[1, 1] = [5, 0, 2]
    tensor[0, 0] = [1, 1, 1]
    rows = {(r["filter_order"], r["step"]): r for r in interactions.contract(tensor, "PQ")}
    assert [rows["QP", k]["removed"] for k in (1, 2)] == [5, 10] and rows["QP", 2]["redundant"] == 5
    assert [rows["PQ", k]["removed"] for k in (1, 2)] == [15, 0] and rows["PQ", 2]["redundant"] == 5
    assert rows["PQ", 2]["kept"] == rows["QP", 2]["kept"] == 1
    assert rows["PQ", 1]["shapley"] == 25 and rows["PQ", 1]["unique_fails"] == 10 and rows["PQ", 2]["unique_fails"] == 0
    assert rows["PQ", 1]["toxic_lost"] == 2 and rows["QP", 2]["good_lost"] == 1


def test_too_many_filters_are_refused(spark):
    counts = spark.createDataFrame([], "part string, cell int, n long, good long, toxic long")
    for filters in ("ABCDEFGH", "AA"):
        with pytest.raises(ValueError):
            interactions.audit(counts, filters)
