import random

import pytest
from pyspark.sql import types as T

SMALL = "/root/testdata/sf0.001"

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        # names that operators use inside or return
        T.StructField("score", T.StringType()),
        T.StructField("found", T.StringType()),
        T.StructField("copy", T.StringType()),
        T.StructField("digest", T.StringType()),
        T.StructField("shard", T.StringType()),
        T.StructField("length", T.StringType()),
        T.StructField("component_id", T.StringType()),
    ]
)


def documents(spark, texts, langs=None, first=0):
    rows = [
        (first + i, t, langs[i] if langs else "en", f"src{i % 3}", len(t or ""), *["x"] * 7)
        for i, t in enumerate(texts)
    ]
    return spark.createDataFrame(rows, DOCS)


def prose(seed, words):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(words))


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Nulls, empty, blank, short, very long, repeated and odd texts."""
    texts = [
        None,
        "",
        "   ",
        "one",
        "a b c d e",
        prose(1, 300),
        prose(1, 300),
        prose(2, 30_000),
        "x" * 50_000,
        "ab " * 5000,
        "naïve café 你好 👍 ▁ \x00 end",
        "1234 5678 !!",
        prose(3, 40) + " " + prose(1, 100),
    ]
    return documents(spark, texts, [None, "en", "de", *["en"] * 5, "de", "fr", None, "es", "en"])


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)
