import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

#: Null ids and texts, blanks, repeated rows, ties, a long text, and columns whose names operators use themselves.
LONG = " ".join(f"word{i % 977} tail{i}" for i in range(30_000))
ODD = [
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (1, "the quick brown fox jumps over the lazy dog again and again today", "en", "a"),
    (2, "The QUICK brown fox jumps over\tthe lazy dog again and again today", "en", None),
    (3, "", "en", "a"),
    (4, None, None, "b"),
    (5, " \t\n\x0b ", "en", "b"),
    (None, "the quick brown fox jumps over the lazy dog again and again today", "en", "b"),
    (6, "one two", "en", "b"),
    (7, "ONE two", "en", "b"),
    (8, LONG, "en", "a"),
    (9, "é😀 " * 7 + "\n\n" + "x", "fr", "a"),
]


@pytest.fixture(scope="session")
def odd(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame(ODD, "doc_id long, text string, lang string, source string")
    return docs.select("*", F.lit(1).alias("node"), F.lit("k").alias("h"), F.lit(2.5).alias("_words"), F.lit("x").alias("n_words"), F.lit(7).alias("component_id"))


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
