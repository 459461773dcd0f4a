import os

import pytest
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def sf():
    if not os.path.isdir(DATA):
        pytest.skip("no test tables here")
    return DATA


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls in every column, empty and wordless texts, ties, repeated rows, a long text and columns with clashing names."""
    long_text = "Lorem ipsum dolor sit amet. " * 4000
    rows = [
        (1, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
        (2, "The quick brown fox jumps over the lazy dog near the river bank today.", "en"),
        (3, None, "en"), (4, "", None), (5, " \n\t ", "de"), (6, "!!! 123 ...", "fr"), (None, "a text without an id", "en"),
        (7, long_text, "en"), (8, "été déjà où ça " * 30, "fr"), (None, None, None), (9, "x", "en"), (10, "日本語 のテキスト 🙂", "ja"),
    ]
    base = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    clash = ["row", "id", "hits", "fp", "fingerprint", "component_id", "n_words", "score", "uid", "winner", "found", "base", "x", "text_hash", "piece", "start", "length", "bucket"]
    return base.withColumns({c: F.lit(k).cast("int") for k, c in enumerate(clash)} | {"source": F.lit("s"), "n_chars": F.length("text").cast("long")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.limit(0)
