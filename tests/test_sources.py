import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from conftest import rows

from tablewright.sources import (
    connection,
    execute,
    explode_path,
    extract,
    list_objects,
    load,
    parsed,
    read_pages,
    read_records,
    table_schema,
    upsert_table,
    write_records,
)
from tablewright.sources.databases import merge_statement, split_options, upsert_table
from tablewright.sources.http import HttpPost, HttpPostWriter, auth_headers, headers_from, register_http


def test_json_array_object_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"id": 1, "n": "a"},\n {"id": 2, "n": null}]')
    (tmp_path / "object.json").write_text('{"id": 3,\n "n": "c"}')
    (tmp_path / "lines.jsonl").write_text('{"id": 1, "n": "a"}\n\n{"id": 2}\n')
    assert rows(read_records(spark, str(tmp_path / "array.json"))) == [(1, "a"), (2, None)]
    assert rows(read_records(spark, str(tmp_path / "object.json"))) == [(3, "c")]
    lines = read_records(spark, str(tmp_path / "lines.jsonl"), "jsonl", schema="id int, n string")
    assert rows(lines) == [(1, "a"), (2, None)]


def test_csv_is_all_text_and_empty_is_not_null(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note\n01,\n2,"say ""hi"", please"\n3,"two\nlines"\n4,  x \n')
    df = read_records(spark, str(tmp_path / "a.csv"), "csv")
    assert rows(df) == [("01", ""), ("2", 'say "hi", please'), ("3", "two\nlines"), ("4", "  x ")]


@pytest.mark.parametrize("format", ["json", "jsonl", "csv"])
def test_round_trip(spark, tmp_path, format):
    data = [("1", 'q"uote', " pad "), ("2", "", "new\nline"), ("3", "é,;", "x")]
    df = spark.createDataFrame(data, "id string, a string, b string")
    write_records(df, str(tmp_path / "out"), format)
    back = read_records(spark, str(tmp_path / "out"), "csv" if format == "csv" else "jsonl")
    assert rows(back, "id", "a", "b") == data


def test_json_keeps_null_fields(spark, tmp_path):
    write_records(spark.sql("SELECT 1 AS id, CAST(NULL AS STRING) AS n"), str(tmp_path / "out"), "jsonl")
    text = "".join(p.read_text() for p in (tmp_path / "out").glob("part-*"))
    assert json.loads(text) == {"id": 1, "n": None}


def test_unsupported_format(spark, tmp_path):
    with pytest.raises(ValueError, match="unsupported format"):
        read_records(spark, str(tmp_path), "xml")
    with pytest.raises(ValueError, match="unsupported format"):
        write_records(spark.range(1), str(tmp_path / "x"), "xml")


def test_list_objects_is_recursive(spark, tmp_path):
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "a" / "one.csv").write_text("x")
    (tmp_path / "a" / "b" / "two.csv").write_text("xyz")
    (tmp_path / "a" / "b" / "three.json").write_text("{}")
    found = list_objects(spark, str(tmp_path), "*.csv")
    assert [(Path(p).name, n) for p, n in rows(found, "path", "length")] == [("two.csv", 3), ("one.csv", 1)] or sorted(
        n for (n,) in rows(found, "length")
    ) == [1, 3]


def test_extract_binds_parameters(spark):
    assert rows(extract(spark, "SELECT :a AS a", {"a": "x' OR 1=1"})) == [("x' OR 1=1",)]
    assert rows(extract(spark, "SELECT ? + ? AS s", [1, 2])) == [(3,)]


def test_load_modes(spark, table):
    schema = "id int, v string, at int"
    df = lambda *data: spark.createDataFrame(list(data), schema)
    assert load(df((1, "a", 1), (2, "b", 1)), table) == 2
    assert load(df((2, "c", 2)), table, "append") == 1
    assert rows(spark.table(table), "id", "v") == [(1, "a"), (2, "b"), (2, "c")]
    for mode in ("append", "replace", "upsert"):
        assert load(spark.createDataFrame([], schema), table, mode, "id") == 0
    assert spark.table(table).count() == 3
    assert load(df((7, "z", 1)), table, "replace") == 1
    upserted = df((7, "old", 1), (7, "new", 3), (7, "mid", 2), (8, "h", 1))
    assert load(upserted, table, "upsert", "id", "at") == 4
    assert rows(spark.table(table), "id", "v") == [(7, "new"), (8, "h")]
    with pytest.warns(UserWarning, match="appending"):
        load(df((9, "i", 1)), table, "sideways")
    assert spark.table(table).count() == 3
    assert rows(table_schema(spark, table), "ordinal_position", "column_name", "data_type") == [
        (1, "id", "int"), (2, "v", "string"), (3, "at", "int"),
    ]
    execute(spark, f"DROP TABLE {table}")
    assert load(upserted, table, "upsert", "id", "at") == 4
    assert rows(spark.table(table), "id", "v") == [(7, "new"), (8, "h")]


def test_database_options():
    assert connection("postgres", "jdbc:postgresql://h/db", user="u") == (
        "jdbc",
        {"url": "jdbc:postgresql://h/db", "driver": "org.postgresql.Driver", "user": "u"},
    )
    assert connection("bigquery", parentProject="p") == ("bigquery", {"parentProject": "p"})
    with pytest.raises(ValueError, match="unknown vendor"):
        connection("abacus")
    assert split_options("SELECT * FROM t", "id", 0, 100, 4)["dbtable"] == "(SELECT * FROM t) source_rows"


def test_merge_statement():
    assert merge_statement("t", "s1", ["id", "v"], ["id"]) == (
        'MERGE INTO t t USING s1 s ON t."id" = s."id" WHEN MATCHED THEN UPDATE SET "v" = s."v"'
        ' WHEN NOT MATCHED THEN INSERT ("id", "v") VALUES (s."id", s."v")'
    )


def test_merge_statement_of_mysql():
    assert merge_statement("t", "s1", ["id", "v"], ["id"], "mysql") == (
        "INSERT INTO t (`id`, `v`) SELECT `id`, `v` FROM s1 ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    )


def test_upsert_of_nothing_runs_no_statement(spark):
    run = []
    upsert_table(spark.createDataFrame([], "id int"), ("jdbc", {}), "t", "id", run.append, "stage")
    assert run == []


def test_upsert_stages_one_row_per_key_then_merges(spark, monkeypatch):
    staged, statements = [], []
    monkeypatch.setattr(
        "tablewright.sources.databases.write_table", lambda df, source, table, mode: staged.append((table, mode, rows(df)))
    )
    df = spark.createDataFrame([(1, 1), (1, 2), (None, 3)], "id int, v int")
    upsert_table(df, ("jdbc", {}), "t", "id", statements.append, "t_stage", order_by="v")
    assert staged == [("t_stage", "replace", [(None, 3), (1, 2)])]
    assert statements[0].startswith("MERGE INTO t t USING t_stage s")


def page_files(folder, pages, wrap=lambda x: x):
    for number, records in enumerate(pages, start=1):
        (folder / f"{number}.json").write_text(json.dumps(wrap(records)))


def test_paged_source_stops_at_the_end(spark, tmp_path):
    page_files(tmp_path, [[{"id": 1}, {"id": 2}], [{"id": 3}], []])
    df = read_pages(spark, f"file://{tmp_path}/{{page}}.json", max_pages=40, pages_per_task=2)
    assert rows(df, "page") == [(1,), (1,), (2,)]
    assert rows(parsed(df, "id int")) == [(1,), (2,), (3,)]
    assert df.rdd.getNumPartitions() == 20
    first = read_pages(spark, f"file://{tmp_path}/{{page}}.json", max_pages=1, stop_at_bound="true")
    assert rows(first, "page") == [(1,), (1,)]
    with pytest.raises(Exception, match="page 2 has records too"):
        read_pages(spark, f"file://{tmp_path}/{{page}}.json", max_pages=1).collect()


def test_paged_source_follows_the_response_path(spark, tmp_path):
    page_files(tmp_path, [[{"id": 1}], {"id": 2, "name": "é"}], wrap=lambda r: {"data": {"items": r}})
    df = read_pages(spark, f"file://{tmp_path}/{{page}}.json", response_path="data.items", max_pages=5)
    assert rows(parsed(df, "id int, name string")) == [(1, None), (2, "é")]
    single = read_pages(spark, f"file://{tmp_path}/1.json", paginate="false")
    assert rows(single, "record") == [('{"data": {"items": [{"id": 1}]}}',)]


def test_a_page_of_several_files_is_refused(spark, tmp_path):
    (tmp_path / "1").mkdir()
    for n in (0, 1):
        (tmp_path / "1" / f"part-{n}.txt").write_text("[]")
    with pytest.raises(Exception, match="a page is one document"):
        read_pages(spark, f"file://{tmp_path}/{{page}}", max_pages=1).collect()


def test_page_urls_and_headers():
    from tablewright.sources.http import PagedHttpReader

    assert PagedHttpReader({"url": "http://h/x", "per_page": "5"}).page_url(2) == "http://h/x?page=2&per_page=5"
    assert PagedHttpReader({"url": "http://h/x?a=1", "page_param": "p"}).page_url(2) == "http://h/x?a=1&p=2&per_page=100"
    asked = PagedHttpReader({"url": "http://h/x", "params": '{"q": "a b", "tag": ["u", "v"]}', "page_param": "p"})
    assert asked.page_url(3) == "http://h/x?q=a+b&tag=u&tag=v&p=3&per_page=100"
    single = PagedHttpReader({"url": "http://h/x", "params": '{"q": 1}', "paginate": "false"})
    assert single.page_url(1) == "http://h/x?q=1"
    assert auth_headers("bearer", "t") == {"Authorization": "Bearer t"}
    assert auth_headers("api_key", "k", header="X-K") == {"X-K": "k"}
    assert auth_headers("basic", user="u", password="p") == {"Authorization": "Basic dTpw"}
    assert headers_from({"header.A": "1", "auth.kind": "bearer", "auth.token": "t"}) == {"A": "1", "Authorization": "Bearer t"}
    with pytest.raises(ValueError):
        auth_headers("seal")


def test_requests_with_a_method_and_a_body():
    from tablewright.sources.http import PagedHttpReader, request_for

    plain = request_for("http://h/x", {"A": "1"}, "GET", None)
    assert plain.get_method() == "GET" and plain.data is None and plain.headers == {"A": "1"}
    posted = request_for("http://h/x", {"A": "1"}, "post", '{"q": "é"}')
    assert posted.get_method() == "POST" and posted.data.decode() == '{"q": "é"}'
    assert posted.headers == {"A": "1", "Content-type": "application/json"}
    reader = PagedHttpReader({"url": "http://h/x", "method": "POST", "json_body": '{"q": 1}'})
    assert (reader.method, reader.body) == ("POST", '{"q": 1}')
    with pytest.raises(ValueError):
        PagedHttpReader({"url": "http://h/x", "json_body": "{q"})


def test_options_travel_as_json(spark, tmp_path):
    page_files(tmp_path, [[{"id": 1}]])
    df = read_pages(spark, f"file://{tmp_path}/{{page}}.json", max_pages=2, json_body={"q": [1]}, params={})
    assert rows(df, "page") == [(1,)]


class FolderWriter(HttpPostWriter):
    def deliver(self, payload):
        import uuid
        from pathlib import Path

        Path(self.url, f"{uuid.uuid4().hex}.json").write_text(payload)


class FolderPost(HttpPost):
    @classmethod
    def name(cls):
        return "folder_post"

    def writer(self, schema, overwrite):
        return FolderWriter(dict(self.options))


@pytest.mark.parametrize("batch, posts", [("true", {2, 1}), ("false", None)])
def test_post_sink(spark, tmp_path, batch, posts):
    register_http(spark, FolderPost)
    df = spark.range(3).selectExpr("id", "concat('n', id) AS name").coalesce(1)
    df.write.format("folder_post").options(url=str(tmp_path), batch=batch, batch_size="2").mode("append").save()
    bodies = [json.loads(p.read_text()) for p in tmp_path.glob("*.json")]
    if posts:
        assert {len(b) for b in bodies} == posts
        bodies = [r for b in bodies for r in b]
    assert sorted(b["id"] for b in bodies) == [0, 1, 2] and {b["name"] for b in bodies} == {"n0", "n1", "n2"}


def test_explode_path(spark):
    df = spark.createDataFrame([('{"data": {"items": [{"id": 1}, {"id": 2}]}}',), ('{"data": {}}',), (None,)], "body string")
    assert rows(explode_path(df, "body", "id int", "data.items")) == [(1,), (2,)]
    df = spark.createDataFrame([('{"a": {"id": 3}}',), ('{"a": 4}',), ('{"a": [{"id": 5}]}',), ('{"a": null}',)], "body string")
    assert rows(explode_path(df, "body", "id int", "a")) == [(3,), (4,), (5,)]
    with pytest.raises(Exception, match="not JSON"):
        explode_path(spark.createDataFrame([("{oops",)], "body string"), "body", "id int", "a").collect()


def test_explode_path_takes_what_is_there(spark):
    df = spark.createDataFrame(
        [(1, '{"a": {"b c": [{"id": 1, "n": "x"}, {"n": null}, 7, {"id": "no number", "n": {"deep": 1}}]}}'), (2, '{"a": {}}'), (3, None), (4, '{"a": {"b c": null}}'), (5, "5")],
        "k int, body string",
    )
    want = [(None, None), (None, '{"deep":1}'), (1, "x"), (7, None)]
    assert rows(explode_path(df, "body", "id int, n string", "a.b c")) == want
    with pytest.raises(Exception, match="no 'a.b c' in"):
        explode_path(df, "body", "id int", "a.b c", missing="fail").collect()
    assert rows(explode_path(df.filter("k in (1, 3, 4)"), "body", "id int", "a.b c", missing="fail")) == [(n,) for n, _ in want]
    with pytest.raises(ValueError, match="neither"):
        explode_path(df, "body", "id int", "a", missing="perhaps")
    assert rows(explode_path(df, F.col("body"), "v int", "")) == [(None,), (None,), (None,), (5,)]
