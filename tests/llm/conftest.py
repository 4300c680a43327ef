import pytest
from pyspark.sql import functions as F

#: Columns named like those that operators use inside or return; each holds its own name and the row's score.
CLASH = ["h", "t", "ids", "round_trip", "__p", "__host", "__own", "__id", "__sha", "__maybe", "__taken", "__text", "__copy", "keep", "entry", "__was_kept"]


@pytest.fixture(scope="session")
def edge_docs(spark):
    """Documents with nulls, empty and very long texts, ties, repeated rows, and columns named like the operators' own."""
    long = " ".join(f"word{i % 977} line{i % 13}" for i in range(30_000))
    rows = [
        (1, "the same text of some words here", "en", "a", 32, 7, "x"), (2, "the same text of some words here", "en", "a", 32, 7, "x"),
        (2, "the same text of some words here", "en", "a", 32, 7, "x"), (None, "the same text of some words here", None, None, None, None, None),
        (3, None, "en", "b", None, 1, "y"), (4, "", "en", None, 0, 1, "y"), (5, long, "en", "b", len(long), 2, "z"),
        (6, long + " end", "en", "b", len(long) + 4, 2, "z"), (7, "\t\n  ", "de", "c", 4, 3, None), (8, "Größe ▁ Ünïcode 日本 🙂", "de", "c", 20, 3, None),
        (None, "another one without an id", "en", "b", 25, 0, None),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score long, kept string")
    return docs.withColumns({c: F.concat_ws(" ", F.lit(c), "score") for c in CLASH})


@pytest.fixture(scope="session")
def no_docs(edge_docs):
    return edge_docs.limit(0)


@pytest.fixture(scope="session")
def small_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
