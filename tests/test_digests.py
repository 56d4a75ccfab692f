"""Patterns give the same answer on the surroundings of digits as on the whole text."""

import random
import re
import time

from conftest import rows
from pyspark.sql import functions as F

from tallyward.constants import SYSTEM_RULES
from tallyward.functions.digests import EMAIL_PATTERN, has_email, near_digits
from tallyward.operators.classify import _NEAR_DIGITS
from tallyward.operators.pii import DEFAULT_RECOGNIZERS


def texts(rng, n):
    bits = ["4111 1111 1111 1111", "4111-1111", "123-45-6789", "192.168.0.1", "+49 30 1234 567", "(555) 123-4567", "12", "7", "1    2", "1234567", "a", "Word",
            "x" * 9, " ", "    ", "-", "---------", ".", "+", "(", ")", "\n", "ß", "a1b", "_", "@", "a@b.co", "@x.yz", ".@-.ab", "e@f", "DE44500105175407324931"]
    out = ["", "@", "a@b.co@", "1" + " " * 30 + "2" + " abc " * 5 + "3", "    abc    ".join("4111111111111111")]
    return out + ["".join(rng.choice(bits) + rng.choice(["", " ", ""]) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


def test_same_answers(spark):
    data = texts(random.Random(7), 6000)
    df = spark.createDataFrame([(t,) for t in data], "t string").withColumn("near", near_digits(F.col("t")))
    patterns = [r.pattern for r in DEFAULT_RECOGNIZERS if r.near] + ["(?i)" + p for p in sorted(_NEAR_DIGITS)]
    assert len(_NEAR_DIGITS) == 4 and all(any(p == rule[4] for rule in SYSTEM_RULES) for p in _NEAR_DIGITS)
    wrong = df.select(*[F.count_if(F.coalesce(F.col("near").rlike(p), F.lit(False)) != F.col("t").rlike(p)).alias(f"c{i}") for i, p in enumerate(patterns)],
                      *[F.count_if(F.col("t").rlike(p)).alias(f"n{i}") for i, p in enumerate(patterns)],
                      F.count_if(has_email(F.col("t")) != F.col("t").rlike(EMAIL_PATTERN)).alias("c_email")).first()
    assert all(wrong[f"c{i}"] == 0 and wrong[f"n{i}"] > 20 for i in range(len(patterns))) and wrong["c_email"] == 0
    cards = [r.pattern for r in DEFAULT_RECOGNIZERS if r.check == "luhn"][0]
    for r in rows(df.limit(3000)):
        assert re.findall(cards, r["near"] or "") == re.findall(cards, r["t"])


def test_prose_shrinks_and_time_follows_length(spark):
    took = []
    for n in (200_000, 1_600_000):
        hostile = ["lorem ipsum " * (n // 12), " " * n, "s" + " " * n, "- " * (n // 2), "a" * n, "a " * (n // 2), "1 a" * (n // 3), "@" * n, "a@" * (n // 2), "9" * n]
        df = spark.createDataFrame([(t,) for t in hostile], "t string")
        start = time.perf_counter()
        got = rows(df.select(F.length(near_digits(F.concat(F.lit("7"), "t", F.lit("7")))).alias("n"), has_email(F.col("t")).alias("e")))
        took.append(time.perf_counter() - start)
        assert got[0]["n"] < 20 and got[4]["n"] < 20
    assert took[1] < 25
