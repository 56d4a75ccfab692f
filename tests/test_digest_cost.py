"""Short values and numbers pass the digit patterns without being cut or searched."""

from conftest import rows
from pyspark.sql import functions as F

from tallyward.functions import digests
from tallyward.operators import classify, pii

VALUES = [
    "", "7", "12.50", "2024-01-01 00:00:00", "1.2.3.4", "123-45-6789", "4111111111111111", "+1 1 22 22", "+1122334", "555-123-4567", "abcd7efgh",
    "no digit at all here", "call 555 123 4567 or write to someone else at 10.0.0.1 today", "é1.2.3.4é", "GB82WEST12345698765432",
]


def test_digest_is_what_cutting_every_text_gives(spark):
    text = F.col("v")
    always = F.when(text.rlike("[0-9]"), F.regexp_replace(text, digests._STRETCH, ""))
    got = rows(spark.createDataFrame([(v,) for v in VALUES], "v string").select(digests.near_digits(text).alias("new"), always.alias("old")))
    assert [r["new"] for r in got] == [r["old"] for r in got]


def test_rules_and_recognizers_find_what_their_patterns_find(spark):
    text = F.col("v")
    frame = spark.createDataFrame([(v,) for v in VALUES], "v string")
    rules = [r for r in classify.seed_rules() if r.pattern in classify._NEAR_DIGITS]
    assert len(rules) == 4
    plain = [r for r in pii.DEFAULT_RECOGNIZERS if r.check is None and r.near]
    pairs = [(r.matches(text), text.rlike(f"(?i){r.pattern}")) for r in rules] + [(r.fires(text), text.rlike(r.pattern)) for r in plain]
    for new, old in pairs:
        assert frame.where(new != old).count() == 0


def test_values_too_short_are_not_searched(spark):
    frame = spark.createDataFrame([("1.5",)], "v string")
    for df in (classify.classify_columns(frame), pii.detect_pii_values(frame)):
        plan = df._jdf.queryExecution().optimizedPlan().toString()
        assert "octet_length" in plan and digests._LONG_STRETCH in plan
