import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([
    StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
    StructField("source", StringType()), StructField("n_chars", LongType()),
])

LONG = " ".join(f"word{i} runs" for i in range(3_000))
#: Nulls in every column, empty and blank texts, one very long text, ties and repeated rows.
ODD = [
    (None, None, None, None, None), (1, None, "en", "s", 0), (2, "", "en", "s", 0), (3, " \t\n\x0b\x0c\r ", "en", "s", 7),
    (None, "a text without an id but with words", None, None, None),
    (4, LONG, "en", "s", len(LONG)), (5, "same words here", "en", "s", 15), (5, "same words here", "en", "s", 15),
    (6, "same words here", "de", None, 15), (7, "É\U0001f600 ünï çödé words", "fr", "t", 10), (8, "x", "en", "t", 1),
]


@pytest.fixture(scope="session")
def docs(spark):
    """A function that makes documents of (doc_id, text) or whole rows."""
    def make(rows):
        full = [(*r, "en", "s", len(r[1] or ""))[:5] if len(r) == 2 else r for r in rows]
        return spark.createDataFrame(full, DOCS)

    return make


@pytest.fixture(scope="session")
def odd(docs):
    return docs(ODD)


@pytest.fixture(scope="session")
def nothing(docs):
    return docs([])
