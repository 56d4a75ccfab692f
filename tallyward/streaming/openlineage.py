"""Continuous ingestion of runtime lineage events.

Events are split into facts (a name occurs, a job leads from one name to another), and the stream keeps every fact it
has seen as keyed state: a micro-batch goes on with new facts only. Each new name is looked up once, in a stored index
of the catalog of which only the buckets of these names are read. Assets and edges are what facts and answers say
together. As no fact depends on another, tables are the same for any cut of the events into batches.

A store is a folder with the catalog, its index, the facts and the answers of every batch. For a large state set
``spark.sql.streaming.stateStore.providerClass`` to the RocksDB provider.
"""

from __future__ import annotations

from threading import Event

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tallyward.operators.lineage import best_answers, match_index, reference_keys
from tallyward.operators.openlineage import (
    FACT_COLUMNS,
    ResolvedEvents,
    answered,
    event_facts,
    fact_refs,
    new_assets,
    new_edges,
    parse_openlineage,
)

ASSET_COLUMNS = "id string, external_id string, name string, asset_type string, parent_id string, alias string"
_FACTS = ", ".join(f"{c} string" for c in FACT_COLUMNS)
_ANSWERS = "ref string, asset_id string, known_path string"
_INDEX = "kind string, key string, asset_id string, is_unique boolean, known_path string"
#: Buckets of the index: a batch reads those of its new names. Some million keys a bucket are fine.
INDEX_BUCKETS = 16


def _bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("kind", "key"), F.lit(buckets)).cast("int")


def seed_catalog(assets: DataFrame, path: str, buckets: int = INDEX_BUCKETS) -> None:
    """Write the starting catalog of a store and the index of its keys."""
    columns = [c.split()[0] for c in ASSET_COLUMNS.split(", ")]
    for column in columns:
        if column not in assets.columns:
            assets = assets.withColumn(column, F.lit(None).cast("string"))
    assets.select(columns).write.mode("overwrite").parquet(f"{path}/catalog")
    stored = assets.sparkSession.read.schema(ASSET_COLUMNS).parquet(f"{path}/catalog")
    paths = stored.select(F.col("id").alias("asset_id"), F.col("external_id").alias("known_path"))
    index = match_index(stored).join(paths, "asset_id").withColumn("bucket", _bucket(buckets))
    index.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/index/buckets={buckets}")
    spark = assets.sparkSession
    for name, columns_ in (("facts", _FACTS), ("answers", _ANSWERS)):
        spark.createDataFrame([], columns_).write.mode("ignore").parquet(f"{path}/{name}/run=seed/batch=-1")


def _table(spark: SparkSession, path: str, name: str, columns: str) -> DataFrame:
    return spark.read.schema(f"{columns}, run string, batch bigint").parquet(f"{path}/{name}")


def _events(spark: SparkSession, path: str) -> ResolvedEvents:
    """Everything stored; a fact that several streams have met counts once."""
    facts = _table(spark, path, "facts", _FACTS).drop("run", "batch").distinct()
    return ResolvedEvents(facts, _table(spark, path, "answers", _ANSWERS).drop("run", "batch").distinct())


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(ASSET_COLUMNS).parquet(f"{path}/catalog")


def read_placeholders(spark: SparkSession, path: str) -> DataFrame:
    """The assets that events mention and the catalog lacks."""
    return new_assets(_events(spark, path), read_catalog(spark, path))


def read_assets(spark: SparkSession, path: str) -> DataFrame:
    """The catalog and the placeholders of the events."""
    return read_catalog(spark, path).unionByName(read_placeholders(spark, path))


def read_edges(spark: SparkSession, path: str) -> DataFrame:
    return new_edges(_events(spark, path))


def compact(spark: SparkSession, path: str, target: str) -> None:
    """Write the facts and answers of all finished batches as one batch of a store at ``target``.

    The index and the catalog are taken along. A stopped stream may go on at ``target`` with its old checkpoint: what
    it has seen is in the checkpoint, not in the tables.
    """
    read_catalog(spark, path).write.parquet(f"{target}/catalog")
    index = spark.read.schema(f"{_INDEX}, buckets int, bucket int").parquet(f"{path}/index")
    index.repartition("buckets", "bucket").write.partitionBy("buckets", "bucket").parquet(f"{target}/index")
    events = _events(spark, path)
    events.facts.write.parquet(f"{target}/facts/run=compacted/batch=-1")
    events.answers.write.parquet(f"{target}/answers/run=compacted/batch=-1")


def _answers(spark: SparkSession, facts: DataFrame, path: str) -> DataFrame:
    """The assets that the names of new facts answer to, from the buckets of the index that can hold them.

    The driver gets the numbers of these buckets, nothing else.
    """
    index = spark.read.schema(f"{_INDEX}, buckets int, bucket int").parquet(f"{path}/index")
    buckets = index.select(F.max("buckets")).first()[0] or 1
    keys = reference_keys(fact_refs(facts))
    wanted = [r[0] for r in keys.select(_bucket(buckets)).distinct().collect()]
    near = index.where((F.col("buckets") == buckets) & F.col("bucket").isin(wanted))
    resolved = best_answers(keys, near.select("kind", "key", "asset_id", "is_unique"))
    return answered(resolved, near.select(F.col("asset_id").alias("id"), F.col("known_path").alias("external_id")).distinct())


def stream_openlineage(events: DataFrame, path: str, checkpoint: str, **trigger) -> StreamingQuery:
    """Store the facts of a stream of events and the assets that their names answer to.

    The facts that the stream has seen are its state; a micro-batch costs what it brings, not what is stored. A batch
    owns one partition of each table, named by the stream's id and its number, and overwrites that one only, so a
    replayed batch leaves the same tables; the id lives in the checkpoint, so a stream with a new checkpoint adds
    beside earlier ones. No scratch tables are written.
    """
    run: dict[str, str] = {}
    started = Event()

    def store(batch: DataFrame, batch_id: int) -> None:
        started.wait()
        spark, place = batch.sparkSession, f"run={run['id']}/batch={batch_id}"
        batch.write.mode("overwrite").parquet(f"{path}/facts/{place}")
        facts = spark.read.schema(_FACTS).parquet(f"{path}/facts/{place}")
        _answers(spark, facts, path).write.mode("overwrite").parquet(f"{path}/answers/{place}")

    facts = event_facts(parse_openlineage(events)).dropDuplicates(list(FACT_COLUMNS))
    query = (
        facts.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
    run["id"] = str(query.id)
    started.set()
    return query
