"""Closures over the lineage graph by frontier joins, of one set of starts or of many starts at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyward.session import checkpointed, written


# Ids that a closure broadcasts at most: some 64 MB of hashed ids.
BROADCAST_IDS = 500_000


def _start_frame(edges: DataFrame, starts: str | Sequence[str] | DataFrame) -> DataFrame:
    if isinstance(starts, DataFrame):
        return starts.select(F.col(starts.columns[0]).alias("id")).distinct()
    ids = [starts] if isinstance(starts, str) else list(starts)
    kind = edges.schema["source_id"].dataType
    return edges.sparkSession.createDataFrame([(i,) for i in ids], "id string").select(
        F.col("id").cast(kind).alias("id")
    )


def closure(
    edges: DataFrame,
    starts: str | Sequence[str] | DataFrame,
    direction: str = "down",
    max_depth: int | None = None,
) -> DataFrame:
    """(id, depth) of everything reachable from ``starts``, the starts at depth 0.

    One round per hop: the frontier meets the edges on their start column, new ids are those not
    visited yet, so cycles end by themselves. Each round writes its frontier to a reliable
    checkpoint, which keeps the plan short and survives lost executors. Frontier and visited set are
    counted; while they are small they are broadcast and the edges never move, beyond that they are
    shuffled like any other join.
    """
    near, far = ("source_id", "target_id") if direction == "down" else ("target_id", "source_id")
    hops = edges.select(F.col(near).alias("id"), F.col(far).alias("next")).persist(StorageLevel.MEMORY_AND_DISK)
    frontier = checkpointed(_start_frame(edges, starts).withColumn("depth", F.lit(0)))
    size = visited = frontier.count()
    rounds = [frontier]
    depth = 0
    try:
        while size and (max_depth is None or depth < max_depth):
            depth += 1
            step = hops.join(_small(frontier.select("id"), size), "id")
            reached = step.select(F.col("next").alias("id")).distinct()
            seen = _small(_union(rounds).select("id"), visited)
            frontier = checkpointed(reached.join(seen, "id", "left_anti").withColumn("depth", F.lit(depth)))
            size = frontier.count()
            visited += size
            rounds.append(frontier)
            if len(rounds) > 16:
                rounds = [checkpointed(_union(rounds))]
    finally:
        hops.unpersist()
    return _union(rounds)


def _small(ids: DataFrame, rows: int) -> DataFrame:
    """Broadcast a set of ids whose counted size allows it."""
    return F.broadcast(ids) if rows <= BROADCAST_IDS else ids


def _union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


def impact(edges: DataFrame, asset: str | Sequence[str] | DataFrame, max_depth: int | None = None) -> DataFrame:
    """All downstream assets with their distance, the start left out."""
    return closure(edges, asset, "down", max_depth).where(F.col("depth") > 0)


def focus_lineage(edges: DataFrame, asset: str | Sequence[str] | DataFrame) -> DataFrame:
    """Ids upstream or downstream of the asset, itself included; each direction is closed alone."""
    return (
        closure(edges, asset, "up").select("id").union(closure(edges, asset, "down").select("id")).distinct()
    )


BITS = 64
FRONTIERS_KEPT = 12


def reach(edges: DataFrame, starts: DataFrame | None = None, direction: str = "down", max_depth: int | None = None) -> DataFrame:
    """(start, id, depth) of everything that each start reaches, for all starts in one walk; ``depth`` 0 is the start.

    Starts are dealt into words of 64 bits, and a frontier row is (node, word, bits): the starts of that word which
    have just arrived at the node. Arrivals of a round combine by bit-or before they are shuffled, and only bits that
    the node has not had go on, so parallel edges and cycles cost nothing more and need no clearing beforehand. The
    number of rounds is the depth of the graph, whatever the number of starts. Without ``starts`` every node that an
    edge leaves is one. Frontiers are written to the shared folder; null ids take no part.

    Most arrivals are ends of the graph: where the nodes that an edge leaves are few enough to broadcast, only
    arrivals at these go on, and while they are few the edges never move.
    """
    near, far = ("source_id", "target_id") if direction == "down" else ("target_id", "source_id")
    hops = edges.select(F.col(near).alias("id"), F.col(far).alias("next")).where("id IS NOT NULL AND next IS NOT NULL")
    from_ = hops.select("id") if starts is None else starts.select(F.col(starts.columns[0]).alias("id")).where("id IS NOT NULL")
    dealt = from_.distinct().withColumn("part", F.spark_partition_id())
    place = F.row_number().over(Window.partitionBy("part").orderBy("id")) - 1
    word = F.col("part").cast("long") * (1 << 32) + F.floor(place / BITS)
    numbered = written(
        written(dealt, "starts").select(F.col("id").alias("start"), word.alias("word"), (place % BITS).cast("int").alias("bit")), "start-bits"
    )
    hops = hops.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        first = numbered.select(F.col("start").alias("id"), "word", F.expr("shiftleft(1L, bit)").alias("bits"), F.lit(0).alias("depth"))
        frontier = written(first, "arrivals")
        rounds, depth = [frontier], 0
        inner = numbered.select(F.col("start").alias("id")) if starts is None else written(hops.select("id").distinct(), "inner-nodes")
        few = inner.count() <= BROADCAST_IDS

        def going(arrivals: DataFrame) -> tuple[DataFrame, int]:
            on = written(arrivals.join(F.broadcast(inner), "id", "left_semi"), "going") if few else arrivals
            return on, on.count()

        onward, size = going(frontier)
        while (max_depth is None or depth < max_depth) and size:
            depth += 1
            arrived = _small(onward, size).join(hops, "id").groupBy(F.col("next").alias("id"), "word").agg(F.bit_or("bits").alias("got"))
            had = _union(rounds).groupBy("id", "word").agg(F.bit_or("bits").alias("had"))
            fresh = arrived.join(had, ["id", "word"], "left").select(
                "id", "word", F.expr("got & ~coalesce(had, 0L)").alias("bits"), F.lit(depth).alias("depth")
            )
            frontier = written(fresh.where("bits <> 0"), "arrivals")
            onward, size = going(frontier)
            rounds.append(frontier)
            if len(rounds) > FRONTIERS_KEPT:
                rounds = [written(_union(rounds), "arrivals")]
    finally:
        hops.unpersist()
    bit = F.explode(F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda b: F.getbit("bits", b) == 1)).alias("bit")
    return _union(rounds).select("id", "word", "depth", bit).join(numbered, ["word", "bit"]).select("start", "id", "depth")


def impact_of_all(edges: DataFrame, starts: DataFrame | None = None) -> DataFrame:
    """(start, reached, deepest): how many assets lie downstream of each start, and how far away the last of them."""
    return reach(edges, starts).groupBy("start").agg(
        F.count_if(F.col("depth") > 0).alias("reached"), F.max("depth").alias("deepest")
    )


def neighbours_of(edges: DataFrame, asset: str) -> DataFrame:
    """The asset's id and the ids one hop up and down."""
    touching = edges.where((F.col("source_id") == asset) | (F.col("target_id") == asset))
    return touching.select(F.explode(F.array("source_id", "target_id", F.lit(asset))).alias("id")).union(
        _start_frame(edges, asset)
    ).distinct()
