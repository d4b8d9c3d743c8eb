import pytest

from tests.conftest import SMALL


@pytest.fixture(scope="session")
def docs(spark):
    """The smallest documents, as (doc_id, text)."""
    return [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]


@pytest.fixture(scope="session")
def awkward():
    """Rows that every operator must take: nulls, empty and blank texts, repeated rows and ids, a very long text."""
    long = "word number %d of a long text\n" * 1
    return [
        (None, "a null id has a text of some words here"), (1, None), (2, ""), (3, " \t\n"), (4, "one"), (5, "two words"), (6, "same row twice " * 9), (6, "same row twice " * 9), (7, "same id"), (7, "another text"),
        (8, "".join(long % i for i in range(9000))), (9, "x" * 50_000), (10, "Ünïcödé 中文 \U0001f600 'll we've"),
    ]
