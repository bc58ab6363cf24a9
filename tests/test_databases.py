"""Statements for databases, tried on engines that need no connection."""

from datetime import date, datetime
from decimal import Decimal

import duckdb
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from tablewright.sources.databases import bound, cut_predicates, cut_statement, read_query, sql_literal


@settings(deadline=None, max_examples=150)
@given(st.one_of(st.text(st.characters(blacklist_characters="\0", blacklist_categories=["Cs"])), st.integers(-(2**62), 2**62), st.booleans(), st.none(),
                 st.dates(date(1, 1, 1), date(9999, 1, 1)), st.datetimes(datetime(1600, 1, 1), datetime(9000, 1, 1))))
def test_values_come_back_as_they_are(value):
    [found] = duckdb.sql(bound("SELECT :v AS v, ':v' AS text -- :v", {"v": value})).fetchall()
    assert found == (value, ":v")


def test_names_in_quotes_comments_and_casts_stay():
    query = """SELECT ':a', "x:a", `:a`, :a::int, /* :a */ :ab -- it's :a\nFROM t WHERE s IN :l"""
    done = bound(query, {"a": 1, "ab": "x' OR 1=1 --", "l": ["p", "q'"]})
    assert done == """SELECT ':a', "x:a", `:a`, 1::int, /* :a */ 'x'' OR 1=1 --' -- it's :a\nFROM t WHERE s IN ('p', 'q''')"""


def test_backslashes_by_vendor():
    assert sql_literal("a\\'b", "mysql") == "'a\\\\''b'" and sql_literal("a\\'b") == "'a\\''b'"
    assert bound("SELECT 'it\\'s :a', :a", {"a": 2}, "mysql") == "SELECT 'it\\'s :a', 2"
    assert sql_literal(Decimal("-1.50")) == "(-1.50)"


@pytest.mark.parametrize("params", [{}, {"a": 1, "b": 2}, {"a": float("nan")}, {"a": []}, {"a": object()}, {"a": "\0"}])
def test_values_that_do_not_fit_are_refused(params):
    with pytest.raises(ValueError):
        bound("SELECT :a", params)


@pytest.mark.parametrize("data", [[None, 5, 1, 1, 1, 1, 9, 7, 3, 2, -4], [1, 1, 1], [None], list(range(100))])
@pytest.mark.parametrize("parts", [1, 3, 4])
def test_every_row_lies_in_one_part(spark, data, parts):
    spark.createDataFrame([(v,) for v in data], "k int").createOrReplaceTempView("cut_rows")
    query = "SELECT k FROM cut_rows"
    cuts = sorted({r["cut"] for r in spark.sql(cut_statement(query, "k", parts)).collect()})[:-1]
    conditions = cut_predicates("k", cuts)
    assert len(conditions) <= parts
    found = [spark.sql(f"{query} WHERE {c}") for c in conditions]
    assert sorted((r for f in found for r in rows(f)), key=str) == sorted(((v,) for v in data), key=str)
    if data == list(range(100)):
        assert max(f.count() for f in found) <= -(-100 // parts)


def test_split_and_cuts_exclude_each_other(spark):
    with pytest.raises(ValueError):
        read_query(spark, ("jdbc", {"url": "jdbc:x"}), "SELECT 1", ("k", 0, 9, 3), cuts=("k", [1]))
