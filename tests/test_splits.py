"""Files cut into small blocks must read like files read whole."""

import csv
import json
import random

import pytest
from conftest import rows

from tablewright.sources import read_records
from tablewright.sources.splits import CsvLines, JsonObjects, pieces, records, states, summaries

SMALL = "spark.sql.files.maxPartitionBytes"
TEXTS = ['plain', '', 'a,b', 'say "x"', 'two\nlines', '"\n"', '\n\n', '"', '""', ',', 'end\n', 'é"\n,ü', ' lead', '{"a": "}"}', '\\', 'x\r\ny', '[', '"},{"']


@pytest.fixture
def blocks(spark):
    """Sets the size of blocks for a test."""
    before = spark.conf.get(SMALL)
    yield lambda size: spark.conf.set(SMALL, str(size))
    spark.conf.set(SMALL, before)


def table(seed, n):
    rnd = random.Random(seed)
    long = lambda: "".join(rnd.choice(TEXTS) for _ in range(rnd.choice((1, 1, 2, 40))))
    return [(str(k), long(), long()) for k in range(n)]


def write_csv(path, data, end="\n", last=True):
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out, lineterminator=end)
        writer.writerow(("id", "a\nname", "b"))
        writer.writerows(data)
    if not last:
        text = path.read_bytes()
        path.write_bytes(text[: -len(end)])


@pytest.mark.parametrize("size", [150, 1000, 1 << 20])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_in_blocks_is_the_csv(spark, blocks, tmp_path, size, end):
    data = {k: table(k, 25 * k) for k in (0, 1, 2)}
    for k, found in data.items():
        write_csv(tmp_path / f"{k}.csv", found, end, last=k != 1)
    blocks(size)
    found = read_records(spark, str(tmp_path), "csv")
    assert found.columns == ["id", "a\nname", "b"]
    if end == "\n":
        whole = spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path)).fillna("")
        assert rows(found) == rows(whole)
    assert rows(found) == sorted(r for found in data.values() for r in found)


def test_csv_quotes_inside_fields_open_nothing(spark, blocks, tmp_path):
    lines = ["id,a,b", '1,5" disk,x', '2,"q",6"', '3,"a', 'b"c,"d', 'e"', "", "4,,", '5,x', '6,"never', "closed,1"]
    (tmp_path / "a.csv").write_text("\n".join(lines))
    whole = rows(spark.read.options(header=True, quote='"', escape='"', multiLine=True).csv(str(tmp_path)).fillna(""))
    for size in (5, 16, 40, 1000):
        blocks(size)
        assert rows(read_records(spark, str(tmp_path), "csv")) == whole


@pytest.mark.parametrize("size", [300, 1 << 20])
@pytest.mark.parametrize("indent", [None, 2])
def test_json_arrays_in_blocks(spark, blocks, tmp_path, size, indent):
    data = [{"id": int(i), "t": a, "in": {"x": [b, None], "y": {"z": a[:3]}}} for i, a, b in table(7, 80)]
    (tmp_path / "array.json").write_text(json.dumps(data, indent=indent, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "object.json").write_text(json.dumps({"id": -1, "t": "one"}, indent=indent))
    (tmp_path / "none.json").write_text("[]\n")
    blocks(size)
    found = read_records(spark, str(tmp_path), "json", "id int, t string, in struct<x: array<string>, y: struct<z: string>>")
    expected = [(d["id"], d["t"], (d["in"]["x"], (d["in"]["y"]["z"],))) for d in data] + [(-1, "one", None)]
    assert sorted(((r["id"], r["t"], r["in"] and (r["in"]["x"], tuple(r["in"]["y"]))) for r in found.collect()), key=lambda r: r[0]) == sorted(
        expected, key=lambda r: r[0]
    )


def test_a_large_file_is_read_by_many_tasks(spark, blocks, tmp_path):
    write_csv(tmp_path / "a.csv", table(3, 3000))
    blocks(20_000)
    found = read_records(spark, str(tmp_path / "a.csv"), "csv")
    assert found.count() == 3000
    assert pieces(spark, str(tmp_path / "a.csv"), CsvLines()).rdd.getNumPartitions() > 8


def test_states_of_blocks_are_those_of_a_walk(spark, blocks, tmp_path):
    text = "\n".join(f'{k},"' + "x\n" * (k % 5) + '",y' for k in range(200))
    (tmp_path / "a.csv").write_text(text)
    blocks(37)
    found = states(summaries(pieces(spark, str(tmp_path), CsvLines()), CsvLines())).collect()
    for r in found:
        at = 0 if r["start"] == 0 else text.find("\n", r["start"] - 1) + 1
        # a line that begins just at a border belongs to the block before
        candidates = {text[:at].count('"') % 2 == 1, text[: text.find("\n", at) + 1].count('"') % 2 == 1}
        assert r["inside"] in candidates and r["depth"] == 0
    assert len(found) > 20


def test_blocks_of_another_size_are_refused(spark, blocks, tmp_path):
    write_csv(tmp_path / "a.csv", table(5, 500))
    blocks(4000)
    found = records(spark, str(tmp_path), CsvLines())
    blocks(1500)
    with pytest.raises(Exception, match="cut into other blocks"):
        records(spark, str(tmp_path), CsvLines()) and found.select("record").unionAll(found.select("record")).collect()


def test_empty_files_and_folders(spark, blocks, tmp_path):
    (tmp_path / "a.csv").write_text("")
    (tmp_path / "b.csv").write_text("id,t\n")
    (tmp_path / "c.csv").write_text('id,t\n1,"x\ny"')
    blocks(4)
    assert rows(read_records(spark, str(tmp_path), "csv")) == [("1", "x\ny")]
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "e.json").write_text("")
    assert records(spark, str(tmp_path / "d"), JsonObjects()).count() == 0
