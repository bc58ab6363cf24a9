"""A corpus from raw documents: identified, without near-duplicates, clean of the benchmark, with
personal data masked, and packed.

Every stage takes what its predecessor kept, as written; ``run`` applies all of them and leaves
the last one's rows alone behind.

Null and empty texts have no language and go in the first stage. Rows without an id go with
the near-duplicates of a group that has one. Repeated rows are copies, of which one stays; of equal
documents the one with the smallest id stays. An empty table has no sequences. Extra columns are carried up
to the last stage, which returns pieces of sequences.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tablewright.llm.decontaminate import drop_contaminated
from tablewright.llm.language import keep_identified
from tablewright.llm.packing import pack
from tablewright.llm.pii import redact
from tablewright.llm.simhash import one_per_group
from tablewright.scratch import discarding_stages, staged

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def identify(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_identified(docs)


def deduplicate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return one_per_group(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mask(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return redact(docs)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("language", identify),
    ("near_duplicates", deduplicate),
    ("decontamination", decontaminate),
    ("personal_data", mask),
    ("packing", sequences),
]

#: The dictionaries, the fingerprints and the tokenizer have no SQL; see tests/llm.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    with discarding_stages(spark):
        for name, stage in STAGES:
            docs = staged(stage(spark, docs, sf_dir), name, keep=name == STAGES[-1][0])
    return docs
