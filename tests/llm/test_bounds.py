"""What comes to the driver, and what stays in the shared folder."""

import subprocess
import sys
import textwrap
from pathlib import Path

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tablewright.llm import language, queries
from tablewright.llm.batches import sampled_rows
from tablewright.scratch import discarding_stages

from .conftest import SF


def test_sample_is_the_least_rows_by_hash_whole(spark):
    df = spark.range(5_000).select(F.xxhash64("id").alias("o"), F.col("id").alias("v"))
    want = sorted(tuple(r) for r in df.collect())
    for most in (1, 700, 5_000, 9_000):
        assert [tuple(r) for r in sampled_rows(df, "o", most)] == want[:most]
    assert sampled_rows(df.filter("false"), "o", 5) == []
    copies = df.unionByName(df.filter("v < 2").crossJoin(spark.range(300)).select("o", "v"))
    assert [tuple(r) for r in sampled_rows(copies, "o", 700)] == want[:700]


def test_sample_of_many_partitions_fits_a_small_driver():
    """60 partitions, each with more rows than the sample, under a limit that one sample fits."""
    code = """
        from pyspark.sql import SparkSession, functions as F
        from tablewright.llm.batches import sampled_rows
        spark = (SparkSession.builder.master("local[4]").config("spark.driver.maxResultSize", "4m")
                 .config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "8").getOrCreate())
        df = spark.range(0, 600_000, 1, 60).select(F.xxhash64("id").alias("o"), *[F.rand(k).alias(f"v{k}") for k in range(12)])
        assert len(sampled_rows(df, "o", 10_000)) == 10_000
        print("fits")
    """
    root = str(Path(__file__).resolve().parents[2])
    done = subprocess.run([sys.executable, "-c", textwrap.dedent(code)], cwd=root, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fits"), done.stderr[-2000:]


def test_all_pieces_reach_the_dictionary(spark, documents):
    word = lambda k: "".join(chr(97 + int(d)) for d in str(k))
    rows = [(k, f"{word(k)} " * 1_000, "xx") for k in range(language.SAMPLE)] + [(9_999 + k, "same text", "yy") for k in range(50)]
    found = language.fit(documents(*rows), F.lit(True))
    content = dict(zip(found.names, found.contents, strict=True))
    assert all(f"{word(k)} ".encode() in content["xx"] for k in range(language.SAMPLE))
    assert len(content["xx"]) <= language.DICTIONARY and content["yy"] == b"same text"


def test_languages_are_bounded(documents, monkeypatch):
    monkeypatch.setattr(language, "MOST_LANGUAGES", 2)
    rows = [(k, f"text {'abc'[k % 3] * 3}", "pqr"[min(k % 6, 2)]) for k in range(60)]
    assert language.fit(documents(*rows), F.lit(True)).names == ["r", "p"]


@pytest.mark.parametrize("name", [*queries.QUERIES, "pipeline"])
def test_nothing_stays_behind(spark, name, tmp_path):
    """A written answer leaves the shared folder as it was."""
    shared = Path(spark.conf.get("spark.checkpoint.dir"))
    before = {p.name for p in shared.iterdir()}
    run = {**queries.QUERIES, "pipeline": corpus_pipeline.run}[name]
    with discarding_stages(spark):
        run(spark, SF).write.parquet(str(tmp_path / "answer"))
    assert {p.name for p in shared.iterdir()} == before
    assert spark.read.parquet(str(tmp_path / "answer")).count() > 0
