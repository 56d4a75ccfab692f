"""Column classification by name and value rules."""

from __future__ import annotations

import re
from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.constants import RULE_CONFIDENCE, SENSITIVITY_LEVELS, SYSTEM_RULES
from tallyward.functions.digests import EMAIL_PATTERN, has_email, near_digits
from tallyward.functions.reshape import long_text, stack_rows

MAX_RULES = 2_000
#: The seed patterns that find near the digits of a text what they find in the text.
_LEAST = {"US SSN": 11, "Credit Card": 13, "Phone Number": 9, "IP Address": 7}  # characters of the shortest match
_NEAR_DIGITS = {pattern: _LEAST[name] for name, _, _, _, pattern, _ in SYSTEM_RULES if name in _LEAST}


def spark_pattern(pattern: str) -> str:
    """A pattern as Spark's engine writes it: named groups of the (?P<name>...) kind become plain numbered ones."""
    for name in re.findall(r"\(\?P<(\w+)>", pattern):
        pattern = pattern.replace(f"(?P={name})", f"(?:\\{_group_number(pattern, name)})")
    return re.sub(r"\(\?P<\w+>", "(", pattern)


def _group_number(pattern: str, name: str) -> int:
    """Which capturing group a name stands for."""
    before = pattern[: pattern.index(f"(?P<{name}>")]
    plain = re.sub(r"\\.|\[(?:\\.|[^\]\\])*\]", "", before)
    return 1 + len(re.findall(r"\((?!\?)|\(\?P<", plain))


def compiles(pattern: str) -> bool:
    """Whether the engine that evaluates ``rlike`` accepts a pattern."""
    context = SparkContext._active_spark_context
    if context is None:
        raise RuntimeError("patterns are checked by a running Spark session")
    try:
        context._jvm.java.util.regex.Pattern.compile(pattern)
    except (Py4JJavaError, IllegalArgumentException):
        return False
    return True


@dataclass(frozen=True)
class ClassificationRule:
    name: str
    category: str
    sensitivity_level: str
    method: str
    pattern: str | None = None
    keywords: tuple[str, ...] = ()
    active: bool = True

    def usable(self) -> bool:
        """Inactive, empty and malformed rules never match."""
        if not self.active:
            return False
        if self.method == "keyword":
            return bool(self.keywords)
        if self.method != "regex" or not self.pattern:
            return False
        return compiles(spark_pattern(self.pattern))

    def matches(self, text: Column, around: Column | None = None, lowered: Column | None = None) -> Column:
        """Whether the text matches; ``around`` is its :func:`near_digits`, both computed once for all rules."""
        if self.method == "keyword":
            lowered = F.lower(text) if lowered is None else lowered
            return reduce(lambda a, b: a | b, [lowered.contains(k.lower()) for k in self.keywords])
        if self.pattern == EMAIL_PATTERN:
            return has_email(text)
        pattern = f"(?i){spark_pattern(self.pattern)}"
        if self.pattern not in _NEAR_DIGITS:
            return text.rlike(pattern)
        scanned = near_digits(text) if around is None else around
        long_enough = F.octet_length(scanned) >= _NEAR_DIGITS[self.pattern]
        return F.coalesce(long_enough & scanned.rlike(pattern), F.lit(False))  # no digits, no surroundings


def seed_rules() -> list[ClassificationRule]:
    return [ClassificationRule(*rule) for rule in SYSTEM_RULES]


def system_rules(spark) -> DataFrame:
    """The seed rules as a table."""
    return spark.createDataFrame(
        [(n, c, s, m, p, list(k)) for n, c, s, m, p, k in SYSTEM_RULES],
        "name string, category string, sensitivity_level string, detection_method string, "
        "pattern string, keywords array<string>",
    )


def rules_from_frame(rules: DataFrame) -> list[ClassificationRule]:
    """Active rule rows as rule objects; they become expressions, so their number is bounded."""
    rows = rules.where("is_active").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} classification rules")
    return [
        ClassificationRule(
            r["name"], r["category"], r["sensitivity_level"], r["detection_method"], r["pattern"],
            tuple(r["keywords"] or ()),
        )
        for r in rows
    ]


def classify_columns(
    df: DataFrame,
    rules: Sequence[ClassificationRule] | None = None,
    columns: Sequence[str] | None = None,
    asset: str = "",
) -> DataFrame:
    """One finding per (column, matching rule), from one scan of the whole table.

    Every rule is one boolean aggregate per column, combined before the shuffle, so each task sends
    one row per column whatever the table's size. Columns of an empty table still match by name.
    """
    columns = list(columns or df.columns)
    rules = [r for r in (seed_rules() if rules is None else rules) if r.usable()]
    if not rules:
        return df.sparkSession.createDataFrame(
            [], "asset string, column string, rule string, category string, "
            "sensitivity_level string, confidence double"
        )
    value = F.col("value")
    by_value = (
        long_text(df, columns)
        .withColumns({"around": near_digits(value), "lowered": F.lower(value)})
        .groupBy("column")
        .agg(*[F.bool_or(r.matches(value, F.col("around"), F.col("lowered"))).alias(f"hit_{i}") for i, r in enumerate(rules)])
    )
    names = df.sparkSession.createDataFrame([(c,) for c in columns], "column string")
    # by_value holds one row per column of the schema, which bounds the broadcast.
    joined = names.join(F.broadcast(by_value), "column", "left")
    findings = joined.select(
        "column",
        stack_rows(
            [
                F.struct(
                    F.lit(r.name).alias("rule"),
                    F.lit(r.category).alias("category"),
                    F.lit(r.sensitivity_level).alias("sensitivity_level"),
                    (F.coalesce(f"hit_{i}", F.lit(False)) | r.matches(F.col("column"))).alias("hit"),
                )
                for i, r in enumerate(rules)
            ]
        ),
    )
    return findings.where("hit").select(
        F.lit(asset).alias("asset"),
        "column",
        "rule",
        "category",
        "sensitivity_level",
        F.lit(RULE_CONFIDENCE).alias("confidence"),
    )


def sensitivity_rank(level: Column) -> Column:
    """Position in the order, 0-based; anything unknown ranks as the lowest level."""
    position = F.array_position(F.array(*[F.lit(s) for s in SENSITIVITY_LEVELS]), level)
    return F.greatest(F.coalesce(position, F.lit(0)) - 1, F.lit(0))


def sensitivity_name(rank: Column) -> Column:
    return F.element_at(F.array(*[F.lit(s) for s in SENSITIVITY_LEVELS]), (rank + 1).cast("int"))


def max_sensitivity(findings: DataFrame, *keys: str) -> DataFrame:
    """Highest level among the findings of each key."""
    return findings.groupBy(*keys).agg(
        sensitivity_name(F.max(sensitivity_rank(F.col("sensitivity_level")))).alias("sensitivity_level")
    )


def overwrite_sensitivity(assets: DataFrame, levels: DataFrame, key: str = "asset_id") -> DataFrame:
    """Assets with findings take the found level, which may be lower; the others keep theirs."""
    found = levels.select(key, F.col("sensitivity_level").alias("found_level"))
    return (
        assets.join(found, key, "left")
        .withColumn("sensitivity_level", F.coalesce("found_level", "sensitivity_level"))
        .drop("found_level")
    )


def classification_run(findings: DataFrame, columns: DataFrame, run_id: str) -> DataFrame:
    """Columns scanned and total findings of one scan."""
    tally = columns.select(F.lit(1).alias("column_rows"), F.lit(0).alias("finding_rows")).unionAll(
        findings.select(F.lit(0), F.lit(1))
    )
    return tally.agg(
        F.coalesce(F.sum("column_rows"), F.lit(0)).alias("columns_scanned"),
        F.coalesce(F.sum("finding_rows"), F.lit(0)).alias("total_findings"),
    ).select(
        F.lit(run_id).alias("run_id"),
        F.lit("classification").alias("scan_type"),
        "columns_scanned",
        "total_findings",
    )


def findings_for_run(findings: DataFrame, assets: DataFrame, run_id: str) -> DataFrame:
    """Findings of one run with the column's name, newest first."""
    named = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("column"))
    return (
        findings.where(F.col("run_id") == run_id)
        .join(named, "asset_id")
        .orderBy(F.desc("detected_at"), "id")
    )


def latest_findings(findings: DataFrame, assets: DataFrame, limit: int = 500) -> DataFrame:
    """Newest findings with the column's name. The top-k runs before the name lookup."""
    newest = findings.join(assets.select(F.col("id").alias("asset_id")), "asset_id", "left_semi")
    newest = newest.orderBy(F.desc("detected_at"), "id").limit(limit)
    named = assets.select(F.col("id").alias("asset_id"), F.col("name").alias("column"))
    return named.join(F.broadcast(newest), "asset_id").orderBy(F.desc("detected_at"), "id")


def scan_history(runs: DataFrame, org_id: str, limit: int = 100) -> DataFrame:
    return runs.where(F.col("org_id") == org_id).orderBy(F.desc("started_at"), "id").limit(limit)
