"""Connected components by alternating large-star and small-star steps.

Each round is two shuffles over the remaining edges and the number of rounds
grows with the logarithm of the longest path, not with the path itself. Every
round is a table in the shared folder, so nothing grows in the plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodegraph.storage import drop, materialise


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """edges(u, v) -> edges whose ends were moved to the smallest neighbour."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else (
        edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    )
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    out = both.join(least, "u")
    if large:
        return out.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
    moved = out.where("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.union(least.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _settled(edges: DataFrame) -> bool:
    """Whether every u hangs on one v that hangs on none: such stars are components, so no further round is needed to see that nothing moves."""
    if not edges.join(edges.select(F.col("v").alias("u")).distinct(), "u", "left_semi").isEmpty():
        return False
    return edges.groupBy("u").agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id that each id of ``edges`` reaches, ids of any ordered type.

    Rows with a null end and self-loops add no links; ids that occur only in self-loops are kept as their own component.
    """
    e = edges.select(F.col(src).alias("u"), F.col(dst).alias("v")).where("u is not null and v is not null")
    own = e.where("u = v").select("u", F.col("u").alias("v")).distinct()
    cur = materialise(e.where("u != v").distinct(), "cc")
    for _ in range(max_rounds):
        nxt = materialise(_star(_star(cur, True), False), "cc")
        drop(cur)
        cur = nxt
        if _settled(cur):
            break
    else:
        raise RuntimeError("connected components did not settle")
    stars = cur.select(F.col("u").alias("id"), F.col("v").alias("component"))
    roots = stars.select(F.col("component").alias("id"), "component")
    return stars.union(roots).union(own.select(F.col("u").alias("id"), F.col("v").alias("component"))).groupBy("id").agg(F.min("component").alias("component"))
