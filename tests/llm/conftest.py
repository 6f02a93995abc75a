import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))


@pytest.fixture
def rng():
    return random.Random(5)


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, blanks, long texts, ties, repeated rows, and extra columns whose names clash with inner ones."""
    long_text = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        (1, None, "en", "a"),
        (2, "", None, None),
        (3, "   \n\t ", "en", "a"),
        (4, "same text here", "en", "a"),
        (5, "same text here", "en", "b"),
        (5, "same text here", "en", "b"),
        (None, "same text here", None, "b"),
        (6, long_text, "de", None),
        (7, "one", "fr", "c"),
        (8, "x" * 50_000, "fr", "c"),
        (9, "1234 !!! --- 5", "fr", ""),
        (10, "日本語 テキスト \x00 \x1c é", "fr", "ü"),
    ]
    schema = "doc_id long, text string, lang string, source string"
    df = spark.createDataFrame(rows, schema).selectExpr("*", "cast(length(text) as long) as n_chars")
    return df.selectExpr("*", "1 as id", "'t' as t", "2 as size", "0.5 as score", "true as kept", "3 as __text", "4 as __id", "5 as n", "6 as a", "7 as row", "8 as __spans")
