"""Connected components and reachability over edge tables, by rounds of joins on materialised tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from trussflow.session import materialize


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """node, component (least node of its component), for the ends of undirected edges; null ends are ignored.

    Least labels spread along edges and along the labels themselves (pointer jumping), so long chains take a logarithmic
    number of rounds. Labels are aggregated before each shuffle; every round is written to the shared folder.
    """
    e = edges.select(F.col(a).alias("a"), F.col(b).alias("b")).dropna()
    e = materialize(e.union(e.select("b", "a")).distinct(), "edges")
    labels = materialize(e.groupBy(F.col("a").alias("node")).agg(F.least(F.col("node"), F.min("b")).alias("component")), "labels")
    while True:
        spread = e.join(labels, e.b == labels.node).groupBy(F.col("a").alias("node")).agg(F.min("component").alias("near"))
        near = labels.join(spread, "node").select("node", "component", F.least("component", "near").alias("near"))
        hop = labels.select(F.col("node").alias("near"), F.col("component").alias("far"))
        after = materialize(near.join(hop, "near", "left").select("node", F.least("near", "far").alias("component"), (F.least("near", "far") < F.col("component")).alias("moved")), "labels")
        labels = after.select("node", "component")
        if after.where("moved").isEmpty():
            break
    return labels


def reach(edges: DataFrame, start: DataFrame, max_levels: int | None = None, src: str = "src", dst: str = "dst") -> DataFrame:
    """id, level: nodes reachable from ``start(id)`` along directed edges and the least number of steps.

    Semi-naive: each round joins only the newest level; cycles end by themselves. ``max_levels`` bounds the steps.
    """
    e = edges.select(F.col(src).alias("_s"), F.col(dst).alias("id")).dropna().distinct()
    seen = materialize(start.select("id").dropna().distinct().withColumn("level", F.lit(0)), "reach")
    frontier, level = seen, 0
    while max_levels is None or level < max_levels:
        level += 1
        step = e.join(frontier.select(F.col("id").alias("_s")), "_s").select("id").distinct().join(seen, "id", "left_anti")
        frontier = materialize(step.withColumn("level", F.lit(level)), "reach")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen
