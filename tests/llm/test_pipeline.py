"""The pipeline, stage by stage and as a whole."""

import numpy as np
import pytest

import corpus_pipeline
from tablewright.llm import packing, pii

from . import brute
from .conftest import SF, rows_of


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What every stage returned, each from its predecessor's written rows."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, SF).write.parquet(str(folder / name))
        docs = found[name] = spark.read.parquet(str(folder / name))
    return found


def texts(df):
    return dict(df.select("doc_id", "text").collect())


def test_all_but_the_last_return_documents(stages):
    for name, _ in corpus_pipeline.STAGES[:-1]:
        assert stages[name].schema == stages["documents"].schema


def test_each_stage_judges_what_it_got(spark, stages):
    before, after = texts(stages["documents"]), texts(stages["language"])
    assert all(before[k] == t for k, t in after.items()) and len(after) >= 0.98 * len(before)

    unique = texts(stages["near_duplicates"])
    assert sorted(unique) == sorted(k for k, _, first in brute.groups(sorted(after.items())) if k == first)

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    clean = texts(stages["decontamination"])
    assert sorted(clean) == sorted(r[0] for r in brute.contamination(unique.items(), items) if not r[-1])

    masked = texts(stages["personal_data"])
    assert masked.keys() == clean.keys()
    for k, text in masked.items():
        assert text == pii.redacted(clean[k], pii.find(clean[k]))
        assert not brute.spans(text)
    lengths = dict(stages["personal_data"].select("doc_id", "n_chars").collect())
    assert all(lengths[k] == len(t) for k, t in masked.items() if t != clean[k])

    encoder = packing.Encoder(packing.default_tokenizer())
    total = {k: len(encoder.ids(t)) // 4 + 1 for k, t in masked.items()}
    packed = {}
    for r in stages["packing"].collect():
        packed[r["doc_id"]] = packed.get(r["doc_id"], 0) + r["length"]
    assert packed == total


def test_run_gives_what_the_stages_give(spark, stages):
    columns = ["doc_id", "doc_tokens"]
    whole = corpus_pipeline.run(spark, SF)
    assert whole.columns == stages["packing"].columns
    assert rows_of(whole.distinct(), *columns) and set(rows_of(whole, *columns)) == set(rows_of(stages["packing"], *columns))


def test_stages_take_an_empty_table_and_nulls(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(None, None, None, None, None), (1, None, "en", None, 3), (2, "a@b.cd the", None, "s", None)], docs.schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.filter("false"), SF).count() == 0
        stage(spark, odd, SF).collect()
    assert np.isclose(sum(r["length"] for r in packing.pack(odd).filter("doc_id is null").collect()), 1)
