"""Streams drained over the driver tables, and surrogate explanations."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.selection import nth_row
from tallyward.operators import explain
from tallyward.operators.quality import QualityRule
from tallyward.plans import lineage as lineage_plans
from tallyward.plans.registry import Registry
from tallyward.plans.tables import table
from tallyward.session import scratch_path
from tallyward.sources.files import stream_lineage_events
from tallyward.streaming import openlineage as ol
from tallyward.streaming.drift import stream_drift as windowed_drift
from tallyward.streaming.quality import stream_quality as windowed_quality
from tallyward.streaming.runs import run_available

REGISTRY = Registry()
_query = REGISTRY.query


def event_stream(spark, folder) -> DataFrame:
    schema = table(spark, folder, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(folder)


# A window is emitted once the watermark (latest event less one hour) has passed its end.
_CLOSED_SQL = """w AS (SELECT *, date_trunc('day', ts) AS window_start FROM events),
 closed AS (SELECT * FROM w WHERE window_start + INTERVAL 1 DAY <= (SELECT max(ts) FROM events) - INTERVAL 1 HOUR)"""


def _plain_windows(df: DataFrame) -> DataFrame:
    return df.withColumn("window_start", F.col("window_start").cast("timestamp_ntz")).drop("window_end")


@_query(
    "stream_quality",
    f"""WITH {_CLOSED_SQL}, c AS (SELECT window_start, count(*)::BIGINT AS n, (count(*) FILTER (WHERE value < 1))::BIGINT AS low,
          (count(*) FILTER (WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup')))::BIGINT AS odd FROM closed GROUP BY 1)
        SELECT window_start, n AS records_evaluated, 'low_value' AS rule_id, low AS records_failed,
          CASE WHEN low = 0 THEN 'passed' ELSE 'failed' END AS status FROM c
        UNION ALL SELECT window_start, n, 'known_type', odd, CASE WHEN odd = 0 THEN 'passed' ELSE 'failed' END FROM c""",
)
def stream_quality(spark, folder):
    rules = [
        QualityRule("low_value", "range", "value", min_value=1),
        QualityRule("known_type", "in_set", "event_type", values=("view", "click", "purchase", "signup")),
    ]
    stream = windowed_quality(event_stream(spark, folder), rules, "ts")
    return _plain_windows(run_available(spark, stream, "stream-quality"))


@_query(
    "window_quality",
    """WITH c AS (SELECT date_trunc('day', ts) AS window_start, count(*)::BIGINT AS n, (count(*) FILTER (WHERE value < 1))::BIGINT AS low FROM events GROUP BY 1)
        SELECT window_start, n AS records_evaluated, 'low_value' AS rule_id, low AS records_failed,
          CASE WHEN low = 0 THEN 'passed' ELSE 'failed' END AS status FROM c""",
)
def window_quality(spark, folder):
    """The same windows over stored events: all of them, with the last one that a stream still holds open."""
    return _plain_windows(windowed_quality(table(spark, folder, "events"), [QualityRule("low_value", "range", "value", min_value=1)], "ts"))


@_query(
    "stream_drift",
    f"""WITH {_CLOSED_SQL}, base AS (SELECT value FROM events WHERE ts < TIMESTAMP '2024-01-08'),
        r AS (SELECT min(value) AS lo, max(value) AS hi FROM base),
        slots AS (SELECT unnest(range(0, 10)) AS slot),
        pb AS (SELECT slot, greatest(count(v) / (SELECT count(*) FROM base), 1e-6) AS pb FROM slots LEFT JOIN (
          SELECT value AS v, CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 9 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS INT), 9) END AS s FROM base, r) ON s = slot GROUP BY 1),
        cs AS (SELECT window_start, CASE WHEN value < lo THEN 0 WHEN value >= hi THEN 9 ELSE least(CAST(floor((value - lo) / ((hi - lo) / 10)) AS INT), 9) END AS s FROM closed, r),
        n AS (SELECT window_start, count(*)::BIGINT AS n FROM cs GROUP BY 1),
        pc AS (SELECT n.window_start, slot, n, greatest(count(s) / n, 1e-6) AS pc FROM n CROSS JOIN slots LEFT JOIN cs ON cs.window_start = n.window_start AND s = slot GROUP BY 1, 2, 3),
        p AS (SELECT window_start, 'value' AS "column", n, round(sum((pc - pb) * ln(pc / pb)), 4) AS psi FROM pc JOIN pb USING (slot) GROUP BY 1, 3)
        SELECT *, psi >= 0.25 AS is_critical FROM p""",
)
def stream_drift(spark, folder):
    reference = table(spark, folder, "events").where("ts < timestamp_ntz'2024-01-08 00:00:00'")
    stream = windowed_drift(event_stream(spark, folder), reference, ["value"], "ts")
    return _plain_windows(run_available(spark, stream, "stream-drift"))


def _ingested(spark, folder) -> str:
    """A store fed with orders as JSON events in three files, as three micro-batches."""
    inbox, store, state = (scratch_path(spark, f"lineage-{part}") for part in ("inbox", "store", "state"))
    lineage_plans.raw_events(spark, folder).repartition(3).write.text(inbox)
    ol.seed_catalog(lineage_plans.catalog(spark, folder), store)
    stream = stream_lineage_events(spark, inbox, files_per_batch=1)
    ol.stream_openlineage(stream, store, state).awaitTermination()
    return store


@_query("stream_openlineage", lineage_plans.REGISTRY.oracles["openlineage_edges"])
def stream_openlineage(spark, folder):
    return ol.read_edges(spark, _ingested(spark, folder))


@_query("stream_openlineage_assets", lineage_plans.REGISTRY.oracles["openlineage_placeholders"])
def stream_openlineage_assets(spark, folder):
    """The placeholders of the same stream."""
    return ol.read_placeholders(spark, _ingested(spark, folder)).select("id", "external_id", "name", "asset_type")


def _labelled(spark, folder) -> DataFrame:
    documents = table(spark, folder, "documents").selectExpr(
        "doc_id", "n_chars", "length(text) - length(replace(text, ' ', '')) AS blanks", "int(lang = 'en') AS english"
    )
    return documents.join(table(spark, folder, "labels"), "doc_id").select(
        "n_chars", "blanks", "english", "toxic", F.col("quality").alias("label")
    )


@_query("fit_surrogate")
def fit_surrogate(spark, folder):
    """Share of rows that the surrogate labels right, with its size."""
    rows = _labelled(spark, folder)
    surrogate = explain.fit_surrogate(rows, "label")
    scored = surrogate.score(rows.withColumns({c: F.col(c).cast("double") for c in surrogate.features}))
    right = (F.col("p")[1] > 0.5).cast("int") == F.col("label")
    return scored.agg(
        F.round(F.avg(right.cast("double")), 4).alias("accuracy"), F.count(F.lit(1)).alias("rows")
    ).withColumn("trees", F.lit(surrogate.model.getNumTrees))


@_query("global_importance")
def global_importance(spark, folder):
    return explain.global_importance(explain.fit_surrogate(_labelled(spark, folder), "label"))


# A forest of two trees with known leaves: bounds (low, high] by feature, and the output.
_FOREST = [
    ({0: (-math.inf, 1500.0), 2: (-math.inf, 0.5)}, [0.1]), ({0: (-math.inf, 1500.0), 2: (0.5, math.inf)}, [0.25]),
    ({0: (1500.0, math.inf), 3: (-math.inf, 0.5)}, [0.45]), ({0: (1500.0, math.inf), 3: (0.5, math.inf)}, [0.05]),
    ({1: (-math.inf, 200.0)}, [0.15]), ({1: (200.0, math.inf), 0: (-math.inf, 4000.0)}, [0.3]), ({1: (200.0, math.inf), 0: (4000.0, math.inf)}, [0.4]),
]


@_query(
    "known_forest_importance",
    """WITH x AS (
      SELECT row_number() OVER () AS r, coalesce(n_chars::DOUBLE, 0) AS a, coalesce((length(text) - length(replace(text, ' ', '')))::DOUBLE, 0) AS b,
        coalesce((lang = 'en')::INT::DOUBLE, 0) AS c, coalesce(toxic::DOUBLE, 0) AS d FROM documents JOIN labels USING (doc_id)
    ), m AS (SELECT avg(a) AS ma, avg(b) AS mb, avg(c) AS mc, avg(d) AS md FROM x
    ), mixed AS (
      SELECT r, code, bit_count(code) AS k, CASE WHEN code & 1 > 0 THEN a ELSE ma END AS a, CASE WHEN code & 2 > 0 THEN b ELSE mb END AS b,
        CASE WHEN code & 4 > 0 THEN c ELSE mc END AS c, CASE WHEN code & 8 > 0 THEN d ELSE md END AS d
      FROM x, m, (SELECT unnest(range(16)) AS code)
    ), scored AS (
      SELECT r, code, k, CASE WHEN a <= 1500 THEN CASE WHEN c <= 0.5 THEN 0.1 ELSE 0.25 END ELSE CASE WHEN d <= 0.5 THEN 0.45 ELSE 0.05 END END
        + CASE WHEN b <= 200 THEN 0.15 WHEN a <= 4000 THEN 0.3 ELSE 0.4 END AS v FROM mixed
    ), phi AS (
      SELECT r, i, abs(sum(CAST(v AS DOUBLE) * CASE WHEN (code >> i) & 1 = 1 THEN [0.25, 1.0 / 12, 1.0 / 12, 0.25][k] ELSE -([0.25, 1.0 / 12, 1.0 / 12, 0.25][k + 1]) END)) AS p
      FROM scored, (SELECT unnest(range(4)) AS i) GROUP BY r, i
    )
    SELECT ['n_chars', 'blanks', 'english', 'toxic'][i + 1] AS feature, round(sum(p) / (SELECT sum(p) FROM phi), 4) AS importance FROM phi GROUP BY i""",
)
def known_forest_importance(spark, folder):
    """The attributions of a forest with known leaves; the SQL scores every coalition of features by definition."""
    names = ("n_chars", "blanks", "english", "toxic")
    rows = _labelled(spark, folder).select([F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in names])
    means = tuple(rows.agg(*[F.avg(c) for c in names]).first())
    return explain.scaled_importance(explain.attributions(rows, names, _FOREST, means), names)


@_query(
    "explained_row",
    """SELECT l_extendedprice, l_orderkey, l_linenumber FROM lineitem ORDER BY ALL
       LIMIT 1 OFFSET (SELECT count(*) // 3 FROM lineitem)""",
)
def explained_row(spark, folder):
    """The row at a third of an order, as a local explanation picks it: found by counts of ranges, not by a sort."""
    rows = table(spark, folder, "lineitem").select("l_extendedprice", "l_orderkey", "l_linenumber")
    return spark.createDataFrame([nth_row(rows, rows.columns, rows.count() // 3)], rows.schema)


@_query(
    "importance_checks",
    """SELECT 4::BIGINT AS features, true AS sums_to_one, true AS not_negative,
      (SELECT count(*) FROM documents JOIN labels USING (doc_id))::BIGINT AS attributed""",
)
def importance_checks(spark, folder):
    """What must hold of any importance: one share per feature, none negative, summing to one, over every row."""
    surrogate = explain.fit_surrogate(_labelled(spark, folder), "label")
    attributed = explain.shapley_values(surrogate).agg(F.lit(1).alias("one"), F.count(F.lit(1)).alias("attributed"))
    shares = explain.global_importance(surrogate).agg(
        F.count(F.lit(1)).alias("features"), (F.abs(F.sum("importance") - 1) < 0.01).alias("sums_to_one"),
        (F.min("importance") >= 0).alias("not_negative"), F.lit(1).alias("one"),
    )
    return shares.join(attributed, "one").drop("one")  # one row each


@_query("local_explanation")
def local_explanation(spark, folder):
    return explain.local_explanation(explain.fit_surrogate(_labelled(spark, folder), "label"), 3)


@_query("stored_importance")
def stored_importance(spark, folder):
    importance = explain.global_importance(explain.fit_surrogate(_labelled(spark, folder), "label"))
    return explain.stored_importance(importance, "version-1", "2024-02-01 00:00:00", "documents")
