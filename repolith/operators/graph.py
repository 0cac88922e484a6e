"""Bounded reachability."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def shortest_depths(edges: DataFrame, starts: DataFrame, depth: int = 8) -> DataFrame:
    """(start, node, depth) for nodes within ``depth`` steps, by one join a step that expands only the nodes the step before reached.

    Each step uses the step before once, so the plan grows in proportion to ``depth``.
    """
    edges = edges.select("src", "dst").distinct()
    seen = starts.select(F.col("node").alias("start"), "node", F.lit(0).alias("depth")).distinct()
    for d in range(1, depth + 1):
        step = seen.join(edges, (F.col("node") == F.col("src")) & (F.col("depth") == d - 1), "left")
        new = F.when(F.col("src").isNotNull(), F.struct(F.col("dst").alias("node"), F.lit(d).alias("depth")))
        step = step.select("start", F.explode(F.array(F.struct("node", "depth"), new)).alias("at")).filter("at IS NOT NULL")
        seen = step.groupBy("start", F.col("at.node").alias("node")).agg(F.min("at.depth").alias("depth"))
    return seen
