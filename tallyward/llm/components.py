"""Connected components of an edge table, without gathering any component."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyward.session import checkpointed


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node of the (a, b) edges; a component is named by its smallest node.

    Alternates two star steps: each node hands its larger neighbours, then its smaller ones, to the smallest
    node it sees. Node degrees shrink to stars in a number of rounds logarithmic in the size. Minima combine
    before the shuffle and are checkpointed before they are joined: both sides of a join are then shuffles of
    their own, so that Spark can split the edges of a hot node. No edges give no rows.
    """
    e = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    e = checkpointed(e)
    seen = None
    while True:
        state = e.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("u", "v"), F.lit(1 << 40)))).first()
        if state == seen or not state[0]:
            break
        seen = state
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = checkpointed(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        big = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        big = checkpointed(big)
        low = checkpointed(big.groupBy("u").agg(F.min("v").alias("m")))
        linked = big.join(low, "u")
        small = linked.select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v")))
        e = checkpointed(small.where("u <> v").distinct())
    roots = e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return e.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
