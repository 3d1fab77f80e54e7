"""Connected components of a link table, by repeated joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.session import written


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """``node, component`` for every node of ``links`` (a, b); the component is its smallest node.

    Large-star and small-star in turn: each step links a node's neighbours to the smallest of
    them, which halves the depth of every tree, until stars are left and nothing changes.
    A hub's links are summed by partial minimum before they move; its joins are left to the adaptive
    skew join, which splits a hub's side by size.
    Every step is a written table.
    """
    both = links.select("a", "b").where("a <> b")
    edges, n = written(both.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), name, **_state())
    state = (n["rows"], n["sum"])
    while n["rows"]:
        # Large star: every larger neighbour of a node moves to the smallest node around.
        around = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = around.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Small star: the smaller neighbours of a node, and itself, move to the smallest of them.
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(small_low, "u")
        moved = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(small_low.select("u", F.col("m").alias("v")))
        edges, n = written(moved.where("u <> v").distinct(), name, **_state())
        if (n["rows"], n["sum"]) == state:
            break
        state = (n["rows"], n["sum"])
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
    return nodes.union(roots)


def _state():
    """Rows and an order-free digest: equal for equal edge sets."""
    return {
        "rows": F.count(F.lit(1)),
        "sum": F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)")),
    }
