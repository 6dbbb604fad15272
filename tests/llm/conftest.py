import pytest

CLASHING = "doc_id long, text string, lang string, source string, n_chars long, id long, digest string, block int, node int, rest string"
EDGE = [
    (1, "Same words here, more than ten.\nshort", "en", "a", 5, 7, "x", 1, 1, "r"),
    (2, "same words here, MORE than ten.\nother line of text", "en", "a", 5, 7, "x", 1, 1, "r"),
    (3, "same words here, MORE than ten.\nother line of text", "en", "b", 5, 7, None, 1, 1, "r"),
    (4, None, None, None, None, None, None, None, None, None),
    (5, "", "de", "b", 0, 7, "x", 1, 1, "r"),
    (6, "12345 !!! ...", "de", "b", 13, 7, "x", 1, 1, "r"),
    (7, "ein wort und noch eins für später " * 4000, "de", "a", 9, 7, "x", 1, 1, "r"),
    (7, "ein wort und noch eins für später " * 4000, "de", "a", 9, 7, "x", 1, 1, "r"),
]


@pytest.fixture(scope="session")
def edge(spark):
    """Nulls, empty, very long and repeated rows, ties, and extra columns whose names the operators use inside."""
    return spark.createDataFrame(EDGE, CLASHING)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], CLASHING)


@pytest.fixture(scope="session")
def docs(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
