import pytest
from pyspark.sql import types as T

DOCUMENT = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])
LONG = "Long words, and a great many of them. " * 3000
ODD_ROWS = [
    (1, None, "en", "a", None), (2, "", "en", None, 0), (3, "same text here, twice over.", "en", "a", 27), (4, "same text here, twice over.", None, "a", 27),
    (4, "same text here, twice over.", None, "a", 27), (None, "no id", "fr", "b", 5), (None, None, None, None, None), (7, LONG, "en", "a", len(LONG)),
    (8, "   \n\t ", "de", "a", 6), (9, "Ünïcode ☃ \U0001f600 text\nand lines", "de", "b", 28), (10, "a" * 5000, "en", "a", 5000), (11, "token=abcdefgh12345 and 0123456789abcdef0123456789abcdef", "en", "a", 54),
]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows and null ids."""
    return spark.createDataFrame(ODD_ROWS, DOCUMENT)


@pytest.fixture(scope="session")
def odd_dir(odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("odd"))
    odd.write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.fixture(scope="session")
def empty_dir(odd, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("empty"))
    odd.limit(0).write.parquet(f"{folder}/documents.parquet")
    return folder
