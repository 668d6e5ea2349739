"""Fixtures and inputs for the operators' tests (imported by name; the folder has no conftest,
so that the parent's stays the only module of that name)."""
import random

import pytest
from pyspark.sql import types as T

from duelframe.llm.common import prepare

DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()),
                     T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()),
                     T.StructField("n_chars", T.LongType())])


@pytest.fixture(scope="session")
def llm(spark):
    return prepare(spark)


def sentence(rnd, n, words):
    return " ".join(rnd.choice(words) for _ in range(n))


def make_docs(spark, texts, langs=None, first=0, extra=None):
    """documents-shaped rows; ``extra`` adds columns (name -> value) with clashing names."""
    rows = [(first + i, t, (langs or ["en"] * len(texts))[i], f"src{i % 3}", None if t is None else len(t))
            for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, DOCS)
    from pyspark.sql import functions as F
    for k, v in (extra or {}).items():
        df = df.withColumn(k, F.lit(v))
    return df


def odd_texts():
    """Null, empty, blank, one word, no letter, very long, repeated and non-ASCII texts."""
    rnd = random.Random(5)
    long = sentence(rnd, 40_000, ["alpha", "beta", "gamma", "delta", "épsilon"])
    return [None, "", " \n\t ", "word", "1234 !!", long, long, "é日本🙂 ña", "a\x00b", "x" * 5000]


@pytest.fixture(scope="session")
def odd(llm):
    """Odd texts with nulls in every column, a repeated row and columns of clashing names."""
    from pyspark.sql import functions as F
    rows = [(i, t, None if i % 2 else "en", None, None) for i, t in enumerate(odd_texts())]
    rows += [(None, "a null id", None, None, None), (None, None, None, None, None), rows[5], rows[3]]
    df = llm.createDataFrame(rows, DOCS)
    clash = "score predicted lang_pred spans ids decoded kept bucket n_tokens id key h a b k class_id".split()
    return df.select("*", *[F.lit("mine").alias(c) for c in clash])


@pytest.fixture(scope="session")
def empty(llm):
    return llm.createDataFrame([], DOCS)
