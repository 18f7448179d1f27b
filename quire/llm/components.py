"""Connected components of a link table, by alternating large and small stars.

Each round hooks every node's larger neighbours to its smallest one (large
star), then its smaller neighbours likewise (small star). The links that are
left form stars around the smallest node of each component. A round holds one
row per link; it ends at the written checkpoint of the next.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import checkpointed


def _star(links: DataFrame, large: bool) -> DataFrame:
    """links: (a, b) with a > b, without repeats."""
    hook = links.unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b"))) if large else links
    least = hook.groupBy("a").agg(F.min("b").alias("m")).withColumn("m", F.least("a", "m")).withColumnRenamed("a", "node")
    joined = hook.join(least, F.col("a") == F.col("node"))
    if large:
        moved = joined.filter(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
    else:
        moved = joined.select(F.col("b").alias("a"), F.col("m").alias("b")).unionAll(least.select(F.col("node").alias("a"), F.col("m").alias("b")))
    return moved.filter(F.col("a") > F.col("b")).distinct()


def connected_components(links: DataFrame) -> DataFrame:
    """(id, component) of every node with a link; links: columns a, b in any order, repeats and loops allowed."""
    edges = checkpointed(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter(F.col("a") > F.col("b")).distinct())
    digest = [F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))]
    state = tuple(edges.agg(*digest).first())
    while state[0]:
        edges = checkpointed(_star(_star(edges, large=True), large=False))
        after = tuple(edges.agg(*digest).first())
        if after == state:
            break
        state = after
    return edges.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(edges.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct())
