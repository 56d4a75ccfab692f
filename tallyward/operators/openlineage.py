"""Runtime lineage events: parsing, placeholder assets and edges."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.functions.names import asset_id
from tallyward.functions.reshape import one_per_key
from tallyward.operators.lineage import match_index, resolve_refs
from tallyward.session import written

# The event fields that are read.
EVENT_SCHEMA = """
    eventType string, run struct<runId: string>, job struct<namespace: string, name: string>,
    inputs array<struct<namespace: string, name: string>>,
    outputs array<struct<namespace: string, name: string, facets: struct<columnLineage: struct<
        fields: map<string, struct<inputFields: array<struct<namespace: string, name: string, field: string>>>>>>>>
"""
DEFAULT_DATASET_NAMESPACE = "external"
DEFAULT_JOB_NAMESPACE = "default"
DEFAULT_JOB_NAME = "unknown_job"


def _filled(text: Column, default: str) -> Column:
    return F.coalesce(F.nullif(text, F.lit("")), F.lit(default))


def _named(datasets: Column) -> Column:
    """Datasets that have a name, their namespace defaulted."""
    kept = F.filter(F.coalesce(datasets, F.array()), lambda d: F.coalesce(d["name"], F.lit("")) != "")
    return F.transform(
        kept,
        lambda d: F.struct(
            _filled(d["namespace"], DEFAULT_DATASET_NAMESPACE).alias("namespace"), d["name"].alias("name")
        ),
    )


def _column_edges(outputs: Column) -> Column:
    """(output_dataset, output_field, input_dataset, input_field) of all columnLineage facets."""

    def of_field(dataset: Column, entry: Column) -> Column:
        inputs = F.filter(
            F.coalesce(entry["value"]["inputFields"], F.array()),
            lambda i: (F.coalesce(i["name"], F.lit("")) != "") & (F.coalesce(i["field"], F.lit("")) != ""),
        )
        return F.transform(
            inputs,
            lambda i: F.struct(
                dataset["name"].alias("output_dataset"),
                entry["key"].alias("output_field"),
                i["name"].alias("input_dataset"),
                i["field"].alias("input_field"),
            ),
        )

    def of_dataset(dataset: Column) -> Column:
        fields = F.coalesce(F.map_entries(dataset["facets"]["columnLineage"]["fields"]), F.array())
        return F.flatten(F.transform(fields, lambda entry: of_field(dataset, entry)))

    kept = F.filter(F.coalesce(outputs, F.array()), lambda d: F.coalesce(d["name"], F.lit("")) != "")
    return F.flatten(F.transform(kept, of_dataset))


def parse_openlineage(events: DataFrame) -> DataFrame:
    """One row per event: job, run, named inputs and outputs, column edges.

    Takes structured events (EVENT_SCHEMA) or raw JSON in a ``value`` column. Everything stays
    within the row, so batch and streaming frames are parsed alike.
    """
    if "value" in events.columns:
        events = events.select(F.from_json("value", EVENT_SCHEMA).alias("event")).select("event.*")
    return events.select(
        _filled(F.col("job.namespace"), DEFAULT_JOB_NAMESPACE).alias("job_namespace"),
        _filled(F.col("job.name"), DEFAULT_JOB_NAME).alias("job_name"),
        F.col("run.runId").alias("run_id"),
        F.col("eventType").alias("event_type"),
        _named(F.col("inputs")).alias("inputs"),
        _named(F.col("outputs")).alias("outputs"),
        _column_edges(F.col("outputs")).alias("column_edges"),
    )


def event_shapes(parsed: DataFrame) -> DataFrame:
    """Distinct (job, inputs, outputs, column edges): a job that runs a million times counts once.

    Events without any dataset are ignored.
    """
    return (
        parsed.where((F.size("inputs") > 0) | (F.size("outputs") > 0))
        .select("job_namespace", "job_name", "inputs", "outputs", "column_edges")
        .distinct()
    )


def _job_path() -> Column:
    return F.concat(F.lit("openlineage://"), F.col("job_namespace"), F.lit("/"), F.col("job_name"))


def _job_id() -> Column:
    return asset_id(F.lit(""), F.lit(""), _job_path())


def _dataset_id(dataset: Column) -> Column:
    """Id of the placeholder of a name: by the name alone, so that no namespace seen later changes it."""
    return asset_id(F.lit(""), F.lit("dataset"), dataset)


def _field_id(parent: Column, field: Column) -> Column:
    return asset_id(F.lit(""), F.lit("column"), F.concat_ws(".", parent, field))


def field_key(dataset: Column, field: Column) -> Column:
    """A field of a dataset under one key; a dataset's own key is its name."""
    return F.concat(dataset, F.lit("\u0001"), field)


FACT_COLUMNS = ("kind", "source", "target", "dataset", "field", "namespace", "job_namespace", "job_name")


def event_facts(shapes: DataFrame) -> DataFrame:
    """What the events say, one fact a row; each is independent of all other facts, and of the order of events.

    ``job``: a job exists. ``dataset``: a name occurs, under a namespace or none. ``field``: a field of a name occurs.
    ``table`` and ``column``: a job leads from a source to a target (keys of datasets or fields).
    """
    unset = F.lit(None).cast("string")

    def fact(kind: str, **values: Column) -> Column:
        return F.struct(F.lit(kind).alias("kind"), *[values.get(c, unset).alias(c) for c in FACT_COLUMNS[1:]])

    job = {"job_namespace": F.col("job_namespace"), "job_name": F.col("job_name")}

    def ends(e: Column) -> Column:
        pairs = [(e[f"{side}_dataset"], e[f"{side}_field"]) for side in ("input", "output")]
        return F.array(
            *[fact("dataset", dataset=d) for d, _ in pairs], *[fact("field", dataset=d, field=f) for d, f in pairs],
            fact("column", source=field_key(*pairs[0]), target=field_key(*pairs[1]), **job),
        )

    facts = F.concat(
        F.array(fact("job", **job)),
        F.transform(F.concat("inputs", "outputs"), lambda d: fact("dataset", dataset=d["name"], namespace=d["namespace"])),
        F.flatten(F.transform("inputs", lambda i: F.transform("outputs", lambda o: fact("table", source=i["name"], target=o["name"], **job)))),
        F.flatten(F.transform("column_edges", ends)),
    )
    return shapes.where((F.size("inputs") > 0) | (F.size("outputs") > 0)).select(F.inline(facts))


def fact_refs(facts: DataFrame) -> DataFrame:
    """(ref) of every name and field that the facts mention, to be resolved against a catalog."""
    ref = F.when(F.col("kind") == "field", F.concat_ws(".", "dataset", "field")).otherwise(F.col("dataset"))
    return facts.where(F.col("kind").isin("dataset", "field")).select(ref.alias("ref")).distinct()


@dataclass(frozen=True)
class ResolvedEvents:
    """Facts of events with the asset of every dataset and field that they name.

    A name or field that no asset of the catalog answers to has a placeholder. Its id depends on the name alone, and
    its path takes the smallest namespace, so the result is the same however the events are dealt into batches.
    """

    facts: DataFrame
    answers: DataFrame

    @property
    def datasets(self) -> DataFrame:
        """(dataset, id, external_id, alias, is_new)"""
        names = self.facts.where("kind = 'dataset'").groupBy("dataset").agg(F.min("namespace").alias("namespace"))
        known = self.answers.select(F.col("ref").alias("dataset"), "asset_id", "known_path")
        path = F.concat_ws(":", F.coalesce("namespace", F.lit(DEFAULT_DATASET_NAMESPACE)), "dataset")
        return names.join(known, "dataset", "left").select(
            "dataset", F.coalesce("asset_id", _dataset_id(F.col("dataset"))).alias("id"),
            F.coalesce("known_path", path).alias("external_id"), F.col("asset_id").isNull().alias("is_new"),
        )

    @property
    def columns(self) -> DataFrame:
        """(dataset, field, ref, parent_id, path, id, is_new)"""
        fields = self.facts.where("kind = 'field'").select("dataset", "field", F.concat_ws(".", "dataset", "field").alias("ref")).distinct()
        parents = self.datasets.select("dataset", F.col("id").alias("parent_id"), F.col("external_id").alias("parent_path"))
        known = self.answers.select("ref", "asset_id")
        return fields.join(parents, "dataset").join(known, "ref", "left").select(
            "dataset", "field", "ref", "parent_id", F.concat_ws(".", "parent_path", "field").alias("path"),
            F.coalesce("asset_id", _field_id(F.col("parent_id"), F.col("field"))).alias("id"), F.col("asset_id").isNull().alias("is_new"),
        )


def answered(resolved: DataFrame, assets: DataFrame) -> DataFrame:
    """(ref, asset_id, known_path) of resolved references."""
    paths = assets.select(F.col("id").alias("asset_id"), F.col("external_id").alias("known_path"))
    return resolved.select("ref", "asset_id").join(paths, "asset_id").select("ref", "asset_id", "known_path")


def resolve_events(shapes: DataFrame, assets: DataFrame) -> ResolvedEvents:
    """Resolve every name of the events once, whatever the number of events.

    Assets and edges both need the facts and the answers, so they are written once and read from there.
    """
    facts = written(event_facts(shapes).distinct(), "event-facts")
    resolved = resolve_refs(fact_refs(facts), match_index(assets))
    return ResolvedEvents(facts, written(answered(resolved, assets), "event-answers"))


def new_assets(events: ResolvedEvents, assets: DataFrame) -> DataFrame:
    """Placeholder datasets and columns, and jobs, that the catalog lacks."""

    def node(id_, path, name, kind, parent, alias):
        return [
            id_.alias("id"), path.alias("external_id"), name.alias("name"), F.lit(kind).alias("asset_type"),
            parent.alias("parent_id"), alias.alias("alias"),
        ]

    nothing = F.lit(None).cast("string")
    last = F.element_at(F.split("dataset", r"\."), -1)
    dataset_nodes = events.datasets.where("is_new").select(
        *node(F.col("id"), F.col("external_id"), F.coalesce(F.nullif(last, F.lit("")), "dataset"),
              "dataset", nothing, F.col("dataset"))
    )
    column_nodes = events.columns.where("is_new").select(
        *node(F.col("id"), F.col("path"), F.col("field"), "column", F.col("parent_id"), F.col("ref"))
    )
    job_nodes = events.facts.where("kind = 'job'").select("job_namespace", "job_name").distinct().select(
        *node(_job_id(), _job_path(), F.col("job_name"), "etl_pipeline", nothing, nothing)
    )
    return (
        dataset_nodes.unionByName(column_nodes)
        .unionByName(job_nodes)
        .transform(one_per_key, ["id"])
        .join(assets.select("id"), "id", "left_anti")
    )


def new_edges(events: ResolvedEvents, existing: DataFrame | None = None) -> DataFrame:
    """Inputs x outputs and column edges of the events that are not stored yet, both kinds through one pair of joins."""
    keys = ["source_id", "target_id", "transform_id", "lineage_type"]
    pairs = events.facts.where("kind IN ('table', 'column')").select(
        "source", "target", F.col("kind").alias("lineage_type"), _job_id().alias("transform_id"), F.col("job_name").alias("logic")
    )
    by_field = events.columns.select(field_key(F.col("dataset"), F.col("field")).alias("key"), "id")
    ids = events.datasets.select(F.col("dataset").alias("key"), "id").unionByName(by_field)
    for side in ("source", "target"):
        pairs = pairs.join(ids.select(F.col("key").alias(side), F.col("id").alias(f"{side}_id")), side)
    edges = pairs.where("source_id <> target_id").groupBy(*keys).agg(F.min("logic").alias("logic"))
    if existing is not None:
        edges = edges.join(existing.select(*keys), keys, "left_anti")
    return edges.select(*keys, "logic", F.lit(1.0).alias("confidence"))


def ingest(parsed: DataFrame, assets: DataFrame, existing: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(new placeholder assets, new edges) for a set of events against a catalog.

    Placeholder ids are hashes of their names, so ingesting the same events again adds nothing.
    """
    events = resolve_events(event_shapes(parsed), assets)
    return new_assets(events, assets), new_edges(events, existing)


def openlineage_placeholders(parsed: DataFrame, assets: DataFrame) -> DataFrame:
    """Assets that the events mention and the catalog lacks."""
    return new_assets(resolve_events(event_shapes(parsed), assets), assets)


def openlineage_edges(parsed: DataFrame, assets: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges of the events that are not stored yet; confidence 1.0."""
    return new_edges(resolve_events(event_shapes(parsed), assets), existing)
