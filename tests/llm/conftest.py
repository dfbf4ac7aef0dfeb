import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Null, empty, blank, very long and repeated texts, ties, null ids and sources, and columns whose names the operators use."""
    long = " ".join(f"word{i % 977} and{i % 31}" for i in range(40_000))
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, " \n\t ", "en", "a", 0), (4, long, "en", "b", 1), (5, long + " more", "en", "b", 1), (6, "same words here", "fr", "a", 1),
        (7, "same words here", "fr", None, 1), (8, "Same WORDS here", "fr", "a", 1), (8, "Same WORDS here", "fr", "a", 1), (None, "no id at all in this one", "en", "c", 1), (9, "é😀 ünïcode 中文 text", "de", "c", 1), (10, "12345 !!", "es", "c", 1),
    ]
    frame = spark.createDataFrame(rows, SCHEMA)
    return frame.selectExpr("*", "1 AS score", "'x' AS lang_pred", "2 AS n_tokens", "3 AS spans", "4 AS shard", "5 AS size", "6 AS kept", "'k' AS key", "7 AS h", "8 AS row")


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], SCHEMA)
