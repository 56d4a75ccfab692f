"""Rows and fixtures for the tests of this folder."""

import random

import pytest
from pyspark.sql import types as T

DOCUMENTS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
    ]
)


def document(doc_id, text, source="s1", lang="en"):
    return (doc_id, text, lang, source, None if text is None else len(text))


def prose(rng, n, words=None):
    words = words or [a + b for a in ("th", "an", "ou", "é", "st") for b in ("er", "ing", "ó", "and", "x", "o.")]
    return " ".join(rng.choice(words) for _ in range(n))


def rows(df, *order):
    """Rows as plain dicts, ordered by the given columns."""
    out = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(out, key=lambda r: tuple(str(r[c]) for c in order)) if order else out


@pytest.fixture
def rng():
    return random.Random(11)


@pytest.fixture
def frame(spark):
    return lambda rows, parts=3: spark.createDataFrame(rows, DOCUMENTS).repartition(parts)


@pytest.fixture
def odd_rows(rng):
    """Nulls in every column, empty, blank and very long texts, ties and repeated rows."""
    same = prose(rng, 60)
    return [
        document(None, None, None, None), document(1, None), document(2, ""), document(3, " \n\t "), document(4, "one"),
        document(5, same), document(5, same), document(6, same, "s2"), document(7, same, None), document(8, prose(rng, 20_000)),
        document(9, "x" * 60_000), document(10, "ß😀é " * 3), document(None, same),
    ]
