import random

import pytest
from pyspark.sql.types import LongType, StringType, StructField, StructType

DOCS = StructType([StructField("doc_id", LongType()), StructField("text", StringType()), StructField("lang", StringType()),
                   StructField("source", StringType()), StructField("n_tokens", StringType())])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls in every column, empty and very long texts, ties, repeated rows, a clashing column."""
    rng = random.Random(7)
    words = ["alpha", "Beta", "gamma", "délta", "ep", "zeta!", "日本", "ètà", "x" * 300]
    some = [" ".join(rng.choices(words, k=rng.randint(1, 60))) for _ in range(40)]
    rows = [(i, t, "en", f"s{i % 3}", "clash") for i, t in enumerate(some)]
    rows += [(100, None, None, None, None), (101, "", "en", "s1", "c"), (102, " \t\n", "en", None, "c"),
             (103, some[3], "en", "s2", "c"), (104, some[3], "fr", "s0", "c"), (105, some[3] + " tail", "fr", "s0", "c"),
             (None, "no id at all", "en", "s1", "c"), (None, some[3], "en", "s1", "c"), (106, "one", None, "s1", "c"),
             (107, "One  TWO", None, "s1", "c"), (7, some[7], "en", "s1", "clash"), (7, some[7], "en", "s1", "clash"),
             (108, "a" * 120_000, "en", "s0", "c"), (109, "lorem ipsum <|endoftext|> <s> dolor▁sit " * 3000, "en", "s0", "c"),
             (110, "\u0000 \U0001f600​՘�", "en", "s0", "c")]
    return rows


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
