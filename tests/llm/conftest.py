import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

SF = "/root/testdata/sf0.001"

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType())])


@pytest.fixture
def documents(spark):
    """A table of (doc_id, text) or (doc_id, text, lang) rows."""

    def make(*rows):
        return spark.createDataFrame([(*r, None)[:3] for r in rows], DOCS)

    return make


#: Texts every operator must take: null, empty, blank, one word, symbols, other scripts, and one
#: of a million characters.
ODD_TEXTS = [None, "", " \n\t ", "word", "#$%&*|<>", "Ünïcödé 漢字 \U0001f600 ªº", "x" * 1_000_000, "a b c " * 60_000, " " * 1_000_000]


@pytest.fixture
def odd(spark, documents):
    """The odd texts, each twice, one row without id, and columns whose names clash."""
    from pyspark.sql import functions as F

    rows = [(k, t) for k, t in enumerate(ODD_TEXTS)] * 2 + [(None, "no id")]
    names = "n_words n_hit items spans contaminated score predicted held_out fingerprint component_id __text __fingerprint id row hash start kept n_removed accepted lang_pred"
    return documents(*rows).select("*", *[F.lit("mine").alias(n) for n in names.split()])


@pytest.fixture
def empty(documents):
    return documents()


def rows_of(df, *columns):
    found = [tuple(r) for r in df.select(*columns).collect()]
    return sorted(found, key=lambda r: [(v is not None, str(type(v)), v) for v in r])
