"""Connected components of a link table by alternating large-star and small-star rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpointed


def _large(edges: DataFrame) -> DataFrame:
    """Every neighbour greater than a node is linked to the least of the node's neighbourhood."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))


def _small(edges: DataFrame) -> DataFrame:
    """Every neighbour not above a node, and the node, is linked to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    moved = down.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v")))


def components(edges: DataFrame, most_rounds: int = 60) -> DataFrame:
    """(node, component) of every node that has a link; component is its least node.

    edges: columns u and v of any ordered type; nulls and loops are ignored, repeats allowed.
    Each round is written to the checkpoint folder; mins are pre-aggregated and hot nodes only
    meet in joins, never in one group. Ends when a round changes nothing."""
    now = checkpointed(edges.select("u", "v").filter("u is not null and v is not null and u <> v").distinct())
    before = None
    for _ in range(most_rounds):
        mark = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if mark == before or not mark[0]:
            break
        before = mark
        now = checkpointed(_small(_large(now).filter("u <> v").distinct()).filter("u <> v").distinct())
    else:
        raise RuntimeError(f"no fixed point after {most_rounds} rounds")
    roots = now.groupBy("v").agg(F.lit(1).alias("_")).select(F.col("v").alias("node"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots).distinct()
