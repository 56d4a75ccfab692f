"""Resolution of written references to catalog assets, and the edges that follow from it."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.functions.names import bare_reference, base_name, segments, suffix, tidy
from tallyward.operators.graph import neighbours_of
from tallyward.session import written

LONGEST_SUFFIX = 3


def match_index(assets: DataFrame) -> DataFrame:
    """(kind, key, asset_id, is_unique): every key under which an asset can be found.

    Keys are the exact external id (and ``alias`` where the catalog has one), its last one to three
    segments, and the name. Uniqueness is min(id) = max(id), which combines before the shuffle, so a
    column name shared by a third of the catalog stays one row per task.
    """
    segs = F.col("segs")
    exact = [tidy(F.col("external_id"))] + ([bare_reference(F.col("alias"))] if "alias" in assets.columns else [])
    keys = F.concat(
        F.array(*[F.struct(F.lit("exact").alias("kind"), k.alias("key")) for k in exact]),
        F.array(F.struct(F.lit("name").alias("kind"), tidy(F.col("name")).alias("key"))),
        F.transform(
            F.filter(
                F.sequence(F.lit(1), F.lit(LONGEST_SUFFIX)),
                lambda k: k <= F.size(segs),
            ),
            lambda k: F.struct(F.lit("suffix").alias("kind"), suffix(segs, k).alias("key")),
        ),
    )
    return (
        assets.withColumn("segs", segments(F.col("external_id")))
        .select("id", F.inline(keys))
        .where(F.col("key").isNotNull() & (F.col("key") != ""))
        .groupBy("kind", "key")
        .agg(F.min("id").alias("asset_id"), (F.min("id") == F.max("id")).alias("is_unique"))
    )


def reference_keys(refs: DataFrame) -> DataFrame:
    """(ref, preference, kind, key, score): every key of :func:`match_index` that a distinct reference may answer to."""
    distinct = refs.select("ref").where(F.col("ref").isNotNull()).distinct()
    distinct = distinct.withColumn("segs", segments(F.col("ref")))
    segs = F.col("segs")

    def candidate(preference: int, kind: str, key, score) -> F.Column:
        return F.struct(
            F.lit(preference).alias("preference"),
            F.lit(kind).alias("kind"),
            key.alias("key"),
            F.lit(score).cast("double").alias("score"),
        )

    candidates = F.array_compact(
        F.array(
            candidate(0, "exact", bare_reference(F.col("ref")), 1.0),
            *[
                F.when(
                    F.size(segs) >= k,
                    candidate(1 + LONGEST_SUFFIX - k, "suffix", suffix(segs, k), 0.9 if k > 1 else 0.75),
                )
                for k in range(LONGEST_SUFFIX, 0, -1)
            ],
            F.when(F.size(segs) > 0, candidate(1 + LONGEST_SUFFIX, "name", F.element_at(segs, -1), None)),
        )
    )
    return distinct.select("ref", F.inline(candidates))


def best_answers(keys: DataFrame, index: DataFrame) -> DataFrame:
    """(ref, asset_id, confidence) of the references whose keys meet the index."""
    found = keys.join(index, ["kind", "key"])
    usable = found.where((F.col("kind") != "suffix") | F.col("is_unique"))
    confidence = F.coalesce("score", F.when(F.col("is_unique"), 0.7).otherwise(0.4))
    best = F.min_by(F.struct("asset_id", confidence.alias("confidence")), "preference")
    return usable.groupBy("ref").agg(best.alias("best")).select("ref", "best.asset_id", "best.confidence")


def resolve_refs(refs: DataFrame, index: DataFrame) -> DataFrame:
    """(ref, asset_id, confidence) for each distinct reference that resolves.

    Exact match 1.0, then the longest unambiguous suffix (0.9, or 0.75 for a single segment), then
    the name (0.7 when unique, else 0.4 with the smallest id).
    """
    return best_answers(reference_keys(refs), index)


def resolve_pairs(statements: DataFrame, index: DataFrame) -> DataFrame:
    """Every source x target of the statements, resolved; drops unresolved and self pairs.

    The statements are given with their lists and keep their other columns. They are written once and
    each distinct reference is resolved once; the answers' size is then known: while it is below the
    broadcast threshold of the session the statements stay where they are, beyond it they are shuffled
    and a very common reference is left to the skew handling of adaptive execution. Targets are looked
    up before the sources are dealt out, so that a statement's row is not multiplied any earlier.
    """
    refs = statements.select(F.explode("sources").alias("ref")).union(statements.select(F.explode("targets")))
    resolved = written(resolve_refs(refs, index), "resolved-refs")
    pairs = statements
    for side in ("target", "source"):
        answer = resolved.select(
            F.col("ref").alias(f"{side}_ref"),
            F.col("asset_id").alias(f"{side}_id"),
            F.col("confidence").alias(f"{side}_confidence"),
        )
        pairs = pairs.withColumn(f"{side}_ref", F.explode(f"{side}s")).drop(f"{side}s").join(answer, f"{side}_ref")
        pairs = pairs.drop(f"{side}_ref")
    return pairs.where(F.col("source_id") != F.col("target_id"))


def _edges(statements: dict[str, DataFrame], index: DataFrame, existing: DataFrame | None) -> DataFrame:
    """Edges of the statements of each lineage type, with the smallest logic and best confidence of their pairs.

    An edge that exists, or that an earlier type has, is not given again: existing edges and all types
    meet in one grouping, so that nothing is sorted for a join. Logic goes through the pairs as its place
    in the order of all distinct ones: the smallest text of a group would need the pairs sorted on both
    sides of the shuffle, the smallest number is hashed. Edges without a transform are never taken for known.
    """
    keys = ["source_id", "target_id", "transform_id"]
    types = list(statements)
    rows = reduce(DataFrame.unionByName, [
        df.select(F.lit(rank).alias("rank"), "transform_id", "logic", "sources", "targets")
        for rank, df in enumerate(statements.values(), 1)
    ])
    rows = written(rows, "lineage-statements")
    logics = rows.select("logic").where("logic IS NOT NULL").distinct().orderBy("logic")
    logics = written(logics.withColumn("place", F.monotonically_increasing_id()), "logic-places")
    found = resolve_pairs(rows.join(logics, "logic", "left").drop("logic"), index).select(
        *keys, "rank", "place", F.least("source_confidence", "target_confidence").alias("confidence")
    )
    if existing is not None:
        known = existing.select(*keys).dropna().withColumn("rank", F.lit(0))
        found = found.unionByName(known, allowMissingColumns=True)
    rank, apart = F.col("rank"), []
    if len(types) > 1:
        found, apart = found.withColumn("apart", F.when(F.col("transform_id").isNull(), rank)), ["apart"]
    bests = [
        best
        for i, kind in enumerate(types, 1)
        for best in (
            F.min(F.when(rank == i, F.col("place"))).alias(f"{kind}_place"),
            F.max(F.when(rank == i, F.col("confidence"))).alias(f"{kind}_confidence"),
        )
    ]
    first = F.col("rank")

    def of_first(value: str) -> F.Column:
        return F.coalesce(*[F.when(first == i, F.col(f"{kind}_{value}")) for i, kind in enumerate(types, 1)])

    edges = (
        found.groupBy(*keys, *apart)
        .agg(F.min("rank").alias("rank"), *bests)
        .where("rank > 0")
        .select(
            *keys,
            F.element_at(F.array(*[F.lit(kind) for kind in types]), first).alias("lineage_type"),
            of_first("place").alias("place"),
            F.round(of_first("confidence"), 2).alias("confidence"),
        )
    )
    return edges.join(logics, "place", "left").select(*keys, "lineage_type", "logic", "confidence")


def _column_statements(columns: DataFrame) -> DataFrame:
    return columns.select(
        "transform_id",
        "logic",
        F.array(F.concat_ws(".", "source_table", "source_column")).alias("sources"),
        F.array(F.concat_ws(".", "target_table", "target_column")).alias("targets"),
    )


def table_edges(statements: DataFrame, index: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges sources x targets of each statement (transform_id, logic, sources, targets).

    Pairs come from exploding the two short lists of a statement; unresolved or self edges are dropped.
    """
    return _edges({"table": statements}, index, existing)


def column_edges(columns: DataFrame, index: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Edges of (transform_id, logic, source_table, source_column, target_table, target_column)."""
    return _edges({"column": _column_statements(columns)}, index, existing)


def rebuild_lineage(
    assets: DataFrame,
    statements: DataFrame,
    columns: DataFrame | None = None,
    existing: DataFrame | None = None,
) -> DataFrame:
    """New edges of all stored references; running it on its own result adds nothing.

    Both edge kinds are resolved and grouped together; a pair that has a table edge gets no column edge.
    """
    index = match_index(assets)
    if columns is None:
        return table_edges(statements, index, existing)
    return _edges({"table": statements, "column": _column_statements(columns)}, index, existing)


def rebuild_counts(statements: DataFrame, edges: DataFrame) -> DataFrame:
    """Pipelines with lineage and edges created."""
    tally = statements.select("transform_id", F.lit(0).alias("edge_rows")).unionAll(
        edges.select(F.lit(None).cast("string"), F.lit(1))
    )
    return tally.agg(
        F.count_distinct("transform_id").alias("assets_with_lineage"),
        F.coalesce(F.sum("edge_rows"), F.lit(0)).alias("edges_created"),
    )


def at_level(edges: DataFrame, level: str = "table") -> DataFrame:
    is_column = F.col("lineage_type") == "column"
    return edges.where(is_column if level == "column" else ~is_column)


def graph_nodes(edges: DataFrame, assets: DataFrame, level: str = "table") -> DataFrame:
    """Assets that an edge of the level touches."""
    endpoints = at_level(edges, level).select(F.explode(F.array("source_id", "target_id")).alias("id"))
    return assets.join(endpoints.distinct(), "id", "left_semi").select(
        "id", "name", "asset_type", "external_id", "sensitivity_level"
    )


def graph_edges(edges: DataFrame, level: str = "table") -> DataFrame:
    return at_level(edges, level).select(
        F.col("source_id").alias("source"),
        F.col("target_id").alias("target"),
        F.col("logic").alias("transformation"),
        "confidence",
    )


def edge_transforms(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, transform): the distinct scripts behind each pair, one per row."""
    return edges.select("source_id", "target_id", base_name(F.col("logic")).alias("transform")).distinct()


def merge_edges(edges: DataFrame) -> DataFrame:
    """(source_id, target_id, transform, n_transforms): one row per script behind a pair, with the exact count.

    The shape is the same for any number of scripts: no list of names is gathered in one row.
    """
    pair = ["source_id", "target_id"]
    transforms = edge_transforms(edges)
    counted = transforms.groupBy(*pair).agg(F.count("transform").alias("n_transforms"))
    return transforms.join(counted, pair).select(*pair, "transform", "n_transforms")


def column_parent_table(nodes: DataFrame) -> DataFrame:
    """Owning table of column nodes: the external id without its ``.name`` suffix."""
    path = F.coalesce("external_id", "name")
    ending = F.concat(F.lit("."), F.col("name"))
    key = F.when(F.endswith(path, ending), F.left(path, F.length(path) - F.length(ending))).otherwise(path)
    return nodes.withColumn("table_key", key).withColumn(
        "table_name", F.element_at(F.split("table_key", r"\."), -1)
    )


def asset_neighbours(edges: DataFrame, assets: DataFrame, asset: str) -> DataFrame:
    """The asset and its direct neighbours, each with a centre flag."""
    ids = neighbours_of(edges, asset)
    return assets.join(ids, "id", "left_semi").select(
        "id", "name", "asset_type", "sensitivity_level", (F.col("id") == asset).alias("is_center")
    )
