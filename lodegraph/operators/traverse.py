"""Breadth-first expansion from many seeds at once: the one primitive behind all traversals."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.schema import Graph
from lodegraph.storage import materialise, measured


def adjacency(graph: Graph, kinds: Iterable[str] | None, direction: str, existing: bool = True) -> DataFrame:
    """(src, dst, edge_id) in the direction of travel; only towards nodes that exist, unless told otherwise."""
    e = graph.edges if kinds is None else graph.edges.where(F.col("kind").isin(list(kinds)))
    a, b = ("from_id", "to_id") if direction == "out" else ("to_id", "from_id")
    e = e.select(F.col(a).alias("src"), F.col(b).alias("dst"), F.col("id").alias("edge_id"))
    return e.join(graph.nodes.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst", "edge_id") if existing else e


def traverse(graph: Graph, seeds: DataFrame, kinds=None, direction: str = "out", max_depth: int | None = None, with_path: bool = False, stop: str | None = None, existing: bool = True) -> DataFrame:
    """seed, id, depth (and path: ids from the seed on; edge_ids), at the least depth, seeds at depth 0.

    ``seeds`` holds one column ``id``. One join a level, all seeds together; each
    level is a table in the shared folder. Of several parents the smallest id counts.
    Ends when a level is empty, at ``max_depth``, or when ``stop`` was reached.
    Whether a node exists is asked of the nodes of a level, not of all edges. The ends
    of a level go to the edges if they are measured to be small, else both are shuffled.
    """
    edges = materialise(adjacency(graph, kinds, direction, False), "adjacency")
    level = seeds.select(F.col("id").alias("seed"), "id", F.lit(0).alias("depth")).distinct()
    if with_path:
        level = level.withColumns({"path": F.array("id"), "edge_ids": F.array().cast("array<string>")})
    level = materialise(level, "level")
    visited = level
    depth = 0
    while max_depth is None or depth < max_depth:
        depth += 1
        ends, n = measured(level.select("seed", F.col("id").alias("src")))
        if not n:
            break
        step = edges.join(ends, "src")
        if with_path:
            best = F.min_by("edge_id", F.struct("src", "edge_id"))
            new = step.groupBy("seed", "dst").agg(F.min_by("src", F.struct("src", "edge_id")).alias("src"), best.alias("edge_id")).select("seed", F.col("dst").alias("id"), "src", "edge_id")
        else:
            new = step.select("seed", F.col("dst").alias("id")).distinct()
        new = new.join(visited.select("seed", "id"), ["seed", "id"], "left_anti")
        if existing:
            new = new.join(graph.nodes.select("id"), "id", "left_semi")
        if with_path:
            new = new.join(level.select("seed", F.col("id").alias("src"), "path", "edge_ids"), ["seed", "src"])
            new = new.withColumns({"path": F.array_append("path", F.col("id")), "edge_ids": F.array_append("edge_ids", F.col("edge_id"))})
        level = materialise(new.withColumn("depth", F.lit(depth)).select(*visited.columns), "level")
        visited = visited.unionByName(level)
        if stop is not None and not level.where(F.col("id") == stop).isEmpty():
            break
    return visited
