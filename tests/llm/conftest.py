import pytest
from brute import phrase

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty, mark-only and very long texts, copies, near copies and repeated rows."""
    base, other = phrase(1), phrase(2)
    near = base.replace(base.split()[60], "changed", 1)
    rows = [
        (1, base, "en", "a", len(base)), (2, base, "en", "b", len(base)), (3, near, "fr", "a", len(near)), (4, other, None, None, None), (4, other, None, None, None),
        (5, None, "en", "a", None), (6, "", "en", "a", 0), (7, "?! --", "de", "c", 5), (None, phrase(3), "en", "a", 10), (None, None, None, None, None),
        (8, phrase(4, 60_000), "en", "a", 300_000), (9, "one two", "en", "a", 7), (10, "One, TWO!", "en", "a", 9), (11, "éé ñ ü ß", "de", "b", 8),
    ]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def docs(spark):
    return spark.read.parquet(f"{FOLDER}/documents.parquet")
