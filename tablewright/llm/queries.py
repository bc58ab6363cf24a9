"""The operators applied to whole test tables, and SQL where it can state the result."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    centroids,
    decontaminate,
    html_text,
    interactions,
    language,
    licenses,
    packing,
    pii,
    quality,
    rules,
    simhash,
    substrings,
    url_filter,
)
from .batches import held_out
from .sql import CENTROIDS_SQL, FILTERS_SQL, LICENSES_SQL, URLS_SQL

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found, names = decontaminate.find_contamination(docs, _table(spark, sf_dir, "benchmark"))
    items = F.col(names["items"])
    return found.select(
        "doc_id",
        F.col(names["n_words"]).alias("n_words"),
        F.col(names["n_hit"]).alias("n_hit"),
        F.size(items).cast("bigint").alias("n_items"),
        F.sha2(F.array_join(items, ","), 256).alias("items_sha256"),
        F.col(names["contaminated"]).alias("contaminated"),
    )


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = quality.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return found


def op3_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_table(spark, sf_dir, "documents"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"))


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.remove_repeats(_table(spark, sf_dir, "documents"))


def op6_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    languages = language.fit(docs, ~held_out("doc_id") & F.col("doc_id").isNotNull())
    found, names = language.predict(docs.select("doc_id", "text"), languages)
    return found.select("doc_id", held_out("doc_id").alias("held_out"), *[F.col(names[n]).alias(n) for n in names])


def op7_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, _ = rules.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    base = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "rule"]
    return found.select("doc_id", *base)


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, names = pii.detect(_table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", *[F.col(names[n]).alias(n) for n in names])


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, names = html_text.extract(_table(spark, sf_dir, "pages"))
    return found.select("page_id", "url", *[F.col(names[n]).alias(n) for n in names])


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = centroids.with_inertia(centroids.cluster(_table(spark, sf_dir, "embeddings"), dims=64))
    return found.withColumnRenamed("id", "vec_id")


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return interactions.audit_filters(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


URL_RULES = (
    url_filter.Rule("net", "/", False),
    url_filter.Rule("example.net", "/en/", True),
    url_filter.Rule("example.com", "/de/", False),
    url_filter.Rule("org", "/fr/", True),
)


def op13_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, names = url_filter.judge(_table(spark, sf_dir, "pages").select("page_id", "url"), URL_RULES)
    return found.select("page_id", *[F.col(names[n]).alias(n) for n in ("host", "path", "rule", "verdict")])


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination,
        op2_quality,
        op3_licenses,
        op4_simhash,
        op5_substrings,
        op6_language,
        op7_rules,
        op8_packing,
        op9_pii,
        op10_html,
        op11_centroids,
        op12_filter_audit,
        op13_urls,
    )
}

SQL: dict[str, str] = {
    "op3_licenses": LICENSES_SQL,
    "op11_centroids": CENTROIDS_SQL,
    "op12_filter_audit": FILTERS_SQL,
    "op13_urls": URLS_SQL,
}
