"""Data-quality rules over whole tables: all row-level rules of a table share one aggregate."""

from __future__ import annotations

from collections.abc import Iterable, Mapping, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyward.constants import AMOUNT_NAME_PATTERN, EMAIL_PATTERN, RULE_DIMENSION
from tallyward.functions.reshape import is_numeric, quoted, same_typed, stack_rows
from tallyward.session import written

ROW_RULES = ("not_null", "regex", "range", "in_set")
MAX_RULES_PER_TABLE = 5_000
MAX_SAMPLES = 10
#: Bits of the filter for repeated texts: at most 2^27, two million words of 64 bits in the broadcast.
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 16, 1 << 27

RESULT_SCHEMA = (
    "asset string, rule_id string, rule_type string, column string, status string, "
    "records_evaluated bigint, records_failed bigint, failure_percentage double, "
    "sample_failures array<string>"
)


@dataclass(frozen=True)
class QualityRule:
    rule_id: str
    rule_type: str
    column: str | None
    pattern: str = ".*"
    min_value: object = None
    max_value: object = None
    values: tuple = ()
    max_age: str | None = None
    active: bool = True

    @property
    def dimension(self) -> str | None:
        return RULE_DIMENSION.get(self.rule_type)


def rules_from_frame(rules: DataFrame) -> list[QualityRule]:
    """Rule rows of one table as rule objects; they become expressions, so their number is bounded."""
    rows = rules.limit(MAX_RULES_PER_TABLE + 1).collect()
    if len(rows) > MAX_RULES_PER_TABLE:
        raise ValueError(f"more than {MAX_RULES_PER_TABLE} rules for one table")
    known = set(QualityRule.__dataclass_fields__)
    out = []
    for row in rows:
        fields = {k: v for k, v in row.asDict().items() if k in known and v is not None}
        if "values" in fields:
            fields["values"] = tuple(fields["values"])
        fields.setdefault("column", None)
        out.append(QualityRule(**fields))
    return out


def _is_number(value: object) -> bool:
    return isinstance(value, (int, float)) and not isinstance(value, bool)


def _configuration_error(df: DataFrame, rule: QualityRule, strict_parity: bool) -> str | None:
    """Why a rule cannot be evaluated, found on the schema before any job runs."""
    kind = rule.rule_type
    needs_column = kind in (*ROW_RULES, "unique") or (kind == "freshness" and not strict_parity)
    if not needs_column:
        return None
    if rule.column is None or rule.column not in df.columns:
        return f"column '{rule.column}' not found"
    if kind == "range":
        bounds = [b for b in (rule.min_value, rule.max_value) if b is not None]
        if not bounds:
            return "range needs a minimum or a maximum"
        textual = isinstance(df.schema[rule.column].dataType, T.StringType)
        if textual and any(_is_number(b) for b in bounds):
            return "numeric range on a text column"
    if kind == "freshness" and rule.max_age is None:
        return "freshness needs max_age"
    return None


def _violation(df: DataFrame, rule: QualityRule) -> Column:
    """True for rows that break a row-level rule; nulls only count against not_null."""
    value = quoted(rule.column)
    if rule.rule_type == "not_null":
        return value.isNull()
    if rule.rule_type == "regex":
        return ~value.cast("string").rlike(rule.pattern)
    if rule.rule_type == "range":
        checks = []
        if rule.min_value is not None:
            checks.append(value < F.lit(rule.min_value))
        if rule.max_value is not None:
            checks.append(value > F.lit(rule.max_value))
        return reduce(lambda a, b: a | b, checks)
    if is_numeric(df, rule.column):
        members = [v for v in rule.values if _is_number(v)]
    elif isinstance(df.schema[rule.column].dataType, T.StringType):
        members = [v for v in rule.values if isinstance(v, str)]
    else:
        members = list(rule.values)
    return value.isNotNull() & (~value.isin(members) if members else F.lit(True))


def _row_struct(rule: QualityRule, failed: Column, passed: Column, error: str | None) -> Column:
    return F.struct(
        F.lit(rule.rule_id).alias("rule_id"),
        F.lit(rule.rule_type).alias("rule_type"),
        F.lit(rule.column).cast("string").alias("column"),
        failed.cast("bigint").alias("failed"),
        passed.alias("passed"),
        F.lit(error).cast("string").alias("error"),
    )


def _texts_and_others(df: DataFrame, columns: Sequence[str]) -> tuple[list[str], list[str]]:
    """Columns whose values are compared as text, and those with a short type of their own."""
    texts = [c for kind, names in same_typed(df, columns) if kind == "string" for c in names]
    return texts, [c for c in columns if c not in texts]


def duplicate_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) for each distinct value of ``columns``, values as text; nulls kept.

    Columns of one type are grouped together in that type, so numbers are hashed and shuffled as
    numbers. The per-value count is combined before the shuffle: a value that fills a third of the
    table arrives as one row per task.
    """
    parts = []
    for kind, names in same_typed(df, columns):
        values = df.select([quoted(c).cast(kind).alias(c) for c in names]).unpivot(
            [], [quoted(c) for c in names], "column", "value"
        )
        counted = values.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.withColumn("value", F.col("value").cast("string")))
    return reduce(DataFrame.unionByName, parts)


def _long_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select([quoted(c).cast("string").alias(c) for c in columns]).unpivot([], [quoted(c) for c in columns], "column", "value")


def repeated_texts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of the texts that occur more than once; a text that occurs once is not shuffled.

    The first pass counts 64-bit hashes and finds those seen twice. They fill a bit filter of bounded size, which is
    broadcast; the second pass groups only the texts that pass it, by their values. A hash that two texts share, or a
    full filter, lets more texts through but changes no count.
    """
    keyed = _long_texts(df, columns).where("value IS NOT NULL").withColumn("h", F.xxhash64("column", "value"))
    twice = written(keyed.groupBy("h").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("h"), "seen-twice")
    bits = LEAST_FILTER_BITS
    wanted = min(16 * twice.count(), MOST_FILTER_BITS)
    while bits < wanted:
        bits *= 2
    place = F.pmod(F.col("h"), F.lit(bits))
    word, bit = F.floor(place / 64).cast("int"), (place % 64).cast("int")
    filled = twice.groupBy(word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    passing = (word == F.col("word")) & (F.getbit(F.col("bits"), bit) == 1)
    likely = keyed.join(F.broadcast(filled), passing, "left_semi")  # at most MOST_FILTER_BITS / 64 rows
    return likely.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def repeated_values(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, value, n) of all values that occur more than once, as text; nulls never repeat."""
    texts, others = _texts_and_others(df, columns)
    parts = []
    if others:
        parts.append(duplicate_counts(df, others).where(F.col("value").isNotNull() & (F.col("n") > 1)))
    if texts:
        parts.append(written(repeated_texts(df, texts), "repeated-texts"))
    return reduce(DataFrame.unionByName, parts)


def _first_per_rule(candidates: DataFrame, samples: int) -> DataFrame:
    """Smallest ``samples`` values per rule; the rank filter runs before the shuffle as well."""
    smallest = Window.partitionBy("rule_id").orderBy("value")
    return (
        candidates.withColumn("rank", F.row_number().over(smallest))
        .where(F.col("rank") <= samples)
        .groupBy("rule_id")
        .agg(F.array_sort(F.collect_list("value")).alias("failing_values"))
    )


def failing_samples(
    df: DataFrame, rules: Sequence[QualityRule], samples: int = MAX_SAMPLES, repeated: DataFrame | None = None
) -> DataFrame:
    """Up to ``samples`` failing values per rule as text, smallest first; ``repeated`` as of :func:`repeated_values`."""
    row_rules = [r for r in rules if r.rule_type in ROW_RULES and r.rule_type != "not_null"]
    unique_rules = [r for r in rules if r.rule_type == "unique"]
    parts = []
    if row_rules:
        hits = F.array_compact(
            F.array(
                *[
                    F.when(
                        _violation(df, r),
                        F.struct(
                            F.lit(r.rule_id).alias("rule_id"),
                            quoted(r.column).cast("string").alias("value"),
                        ),
                    )
                    for r in row_rules
                ]
            )
        )
        parts.append(_first_per_rule(df.select(F.inline(hits)), samples))
    if unique_rules:
        if repeated is None:
            repeated = repeated_values(df, sorted({r.column for r in unique_rules}))
        by_column = F.create_map(
            *[
                x
                for column in sorted({r.column for r in unique_rules})
                for x in (
                    F.lit(column),
                    F.array(*[F.lit(r.rule_id) for r in unique_rules if r.column == column]),
                )
            ]
        )
        copies = F.explode(
            F.array_repeat("value", F.least(F.col("n"), F.lit(samples)).cast("int"))
        ).alias("value")
        parts.append(
            _first_per_rule(
                repeated.select(F.element_at(by_column, F.col("column")).alias("rule_ids"), copies).select(
                    F.explode("rule_ids").alias("rule_id"), "value"
                ),
                samples,
            )
        )
    if not parts:
        return df.sparkSession.createDataFrame([], "rule_id string, failing_values array<string>")
    return reduce(DataFrame.unionByName, parts)


def evaluate_rules(
    df: DataFrame,
    rules: Iterable[QualityRule],
    asset: str = "",
    samples: int = MAX_SAMPLES,
    now: str | None = None,
    strict_parity: bool = False,
) -> DataFrame:
    """One result row per active rule.

    Row-level rules and the row count come from one aggregate over the table; all uniqueness rules
    share one more grouping over (column, value). ``samples=0`` leaves out the failing values and
    the pass that finds them. ``strict_parity`` treats freshness like an unknown rule type, which
    only asks whether the column exists.
    """
    rules = [r for r in rules if r.active]
    if not rules:
        return df.sparkSession.createDataFrame([], RESULT_SCHEMA)
    errors = {r.rule_id: _configuration_error(df, r, strict_parity) for r in rules}
    valid = [r for r in rules if errors[r.rule_id] is None]

    aggregates = [F.count(F.lit(1)).alias("n")]
    structs = []
    for i, rule in enumerate(rules):
        error = errors[rule.rule_id]
        none, true = F.lit(0), F.lit(True)
        if error is not None:
            structs.append(_row_struct(rule, none, F.lit(False), error))
        elif rule.rule_type in ROW_RULES:
            aggregates.append(F.count_if(_violation(df, rule)).alias(f"failed_{i}"))
            structs.append(_row_struct(rule, F.col(f"failed_{i}"), F.col(f"failed_{i}") == 0, None))
        elif rule.rule_type == "unique":
            structs.append(_row_struct(rule, F.lit(None), true, None))
        elif rule.rule_type == "freshness" and not strict_parity:
            aggregates.append(F.max(quoted(rule.column)).alias(f"latest_{i}"))
            reference = F.lit(now).cast("timestamp_ntz") if now else F.localtimestamp()
            oldest = reference - F.expr(f"INTERVAL {rule.max_age}")
            fresh = F.coalesce(F.col(f"latest_{i}").cast("timestamp_ntz") >= oldest, F.lit(False))
            structs.append(_row_struct(rule, none, fresh, None))
        else:
            structs.append(_row_struct(rule, none, F.lit(rule.column in df.columns), None))
    results = df.agg(*aggregates).select("n", stack_rows(structs))

    unique_columns = sorted({r.column for r in valid if r.rule_type == "unique"})
    repeated = repeated_values(df, unique_columns) if unique_columns else None
    if repeated is not None:
        failures = repeated.groupBy("column").agg(F.sum("n").alias("unique_failed"))
        results = (
            results.join(
                failures.withColumn("rule_type", F.lit("unique")),
                ["column", "rule_type"],
                "left",
            )
            .withColumn("failed", F.coalesce("failed", "unique_failed", F.lit(0)))
            .withColumn("passed", F.col("passed") & (F.coalesce("unique_failed", F.lit(0)) == 0))
        )
    if samples and valid:
        results = results.join(failing_samples(df, valid, samples, repeated), "rule_id", "left")
    else:
        results = results.withColumn("failing_values", F.lit(None).cast("array<string>"))

    counted = F.col("rule_type").isin([*ROW_RULES, "unique"])
    broken = F.col("error").isNotNull() | (F.col("n") == 0)
    evaluated = F.when(broken | ~counted, F.lit(0)).otherwise(F.col("n"))
    failed = F.when(broken, F.lit(0)).otherwise(F.col("failed"))
    sample_list = (
        F.when(broken, F.array(F.coalesce("error", F.lit("no sample data"))))
        .when(
            (F.col("rule_type") == "not_null") & F.lit(samples > 0),
            F.array_repeat(F.lit(None).cast("string"), F.least(failed, F.lit(samples)).cast("int")),
        )
        .otherwise(F.coalesce("failing_values", F.array().cast("array<string>")))
    )
    return results.select(
        F.lit(asset).alias("asset"),
        "rule_id",
        "rule_type",
        "column",
        F.when(broken, "error").when(F.col("passed"), "passed").otherwise("failed").alias("status"),
        evaluated.cast("bigint").alias("records_evaluated"),
        failed.cast("bigint").alias("records_failed"),
        F.when(evaluated > 0, failed / evaluated * 100).otherwise(0.0).alias("failure_percentage"),
        sample_list.alias("sample_failures"),
    )


def quality_results(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[QualityRule]], **options
) -> DataFrame:
    """Result rows of every table that has rules; no rows if none has."""
    parts = [evaluate_rules(tables[a], rules[a], asset=a, **options) for a in tables if rules.get(a)]
    if not parts:
        asset, frame = next(iter(tables.items()))
        return evaluate_rules(frame, [QualityRule("", "column_exists", "")], asset=asset, **options).where(F.lit(False))
    return reduce(DataFrame.unionByName, parts)


def score_runs(results: DataFrame, assets: Sequence[str] = ()) -> DataFrame:
    """Score per asset: passed / total * 100; assets without rules keep a null score."""
    scored = results.groupBy("asset").agg(
        F.count(F.lit(1)).alias("total_rules"), F.count_if(F.col("status") == "passed").alias("passed")
    )
    if assets:
        wanted = results.sparkSession.createDataFrame([(a,) for a in assets], "asset string")
        scored = wanted.join(scored, "asset", "left").fillna(0, ["total_rules", "passed"])
    return scored.select(
        "asset",
        F.when(F.col("total_rules") > 0, F.col("passed") / F.col("total_rules") * 100).alias("score"),
        "total_rules",
        "passed",
        (F.col("total_rules") - F.col("passed")).alias("failed"),
    )


def quality_run(
    tables: Mapping[str, DataFrame], rules: Mapping[str, Sequence[QualityRule]], **options
) -> DataFrame:
    """Scorecard over several tables; rules that cannot be evaluated count as failed."""
    return score_runs(quality_results(tables, rules, **options), list(tables))


def latest_runs(runs: DataFrame, n: int = 20) -> DataFrame:
    """The newest ``n`` runs of each asset."""
    newest = Window.partitionBy("asset").orderBy(F.desc("run_at"), "run_id")
    return runs.withColumn("rank", F.row_number().over(newest)).where(F.col("rank") <= n).drop("rank")


def _value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(column, filled, n) per distinct value; texts and other wide values travel as two 64-bit hashes."""
    wide, short = _texts_and_others(df, columns)
    parts = []
    if short:
        parts.append(duplicate_counts(df, short).select("column", F.col("value").isNotNull().alias("filled"), "n"))
    if wide:
        keys = df.select([F.when(quoted(c).isNotNull(), F.struct(F.xxhash64(quoted(c)), F.xxhash64(F.lit(c), quoted(c)))).alias(c) for c in wide])
        long = keys.unpivot([], [quoted(c) for c in wide], "column", "value")
        counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
        parts.append(counted.select("column", F.col("value").isNotNull().alias("filled"), "n"))
    return reduce(DataFrame.unionByName, parts)


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, approximate: bool = False) -> DataFrame:
    """Row, null, non-null and distinct counts per column.

    Exact distinct counts group (column, value) once for all columns, long values under 128 bits of hash.
    ``approximate=True`` trades them for sketches and needs no shuffle of values at all; see
    :mod:`tallyward.operators.profiles` for sketches that are stored and merged.
    """
    columns = list(columns or df.columns)
    numeric = F.col("column").isin([c for c in columns if is_numeric(df, c)])
    if approximate:
        aggregates = [F.count(F.lit(1)).alias("n")]
        structs = []
        for i, c in enumerate(columns):
            aggregates += [
                F.count(quoted(c)).alias(f"filled_{i}"),
                F.approx_count_distinct(quoted(c)).alias(f"distinct_{i}"),
            ]
            structs.append(
                F.struct(
                    F.lit(c).alias("column"),
                    F.col("n").alias("row_count"),
                    F.col(f"filled_{i}").alias("non_null"),
                    F.col(f"distinct_{i}").alias("distinct_count"),
                )
            )
        profile = df.agg(*aggregates).select(stack_rows(structs))
    else:
        profile = (
            _value_counts(df, columns)
            .groupBy("column")
            .agg(
                F.sum("n").alias("row_count"),
                F.coalesce(F.sum(F.when(F.col("filled"), F.col("n"))), F.lit(0)).alias("non_null"),
                F.count_if("filled").alias("distinct_count"),
            )
        )
    return profile.select(
        "column",
        "row_count",
        (F.col("row_count") - F.col("non_null")).alias("null_count"),
        "non_null",
        "distinct_count",
        numeric.alias("is_numeric"),
    )


def suggest_rules(profile: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Default rules from a profile, leaving out (rule_type, column) pairs that exist."""
    name = F.lower("column")
    keyed = (
        (name == "id")
        | name.endswith("_id")
        | name.contains("email")
        | (F.col("distinct_count") == F.col("row_count"))
    )

    def rule(condition: Column, kind: str, minimum: float | None = None, pattern: str | None = None) -> Column:
        return F.when(
            condition,
            F.struct(
                F.lit(kind).alias("rule_type"),
                F.lit(RULE_DIMENSION[kind]).alias("dimension"),
                F.lit(minimum).cast("double").alias("min_value"),
                F.lit(pattern).cast("string").alias("pattern"),
            ),
        )

    candidates = F.array_compact(
        F.array(
            rule((F.col("null_count") == 0) & (F.col("non_null") > 0), "not_null"),
            rule(
                (F.col("non_null") > 1) & (F.col("distinct_count") == F.col("non_null")) & keyed,
                "unique",
            ),
            rule(F.col("is_numeric") & name.rlike(AMOUNT_NAME_PATTERN), "range", minimum=0.0),
            rule(name.contains("email"), "regex", pattern=EMAIL_PATTERN),
        )
    )
    suggested = profile.select("column", F.inline(candidates))
    if existing is not None:
        suggested = suggested.join(existing.select("rule_type", "column"), ["rule_type", "column"], "left_anti")
    return suggested.select("column", "rule_type", "dimension", "min_value", "pattern")
