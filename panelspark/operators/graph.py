"""Connected components of a link table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelspark.operators.joins import shuffled, split_join
from panelspark.session import written

# Links that one task joins in memory (16 bytes each, with what sorting them takes about 100).
LINKS_PER_TASK = 2_000_000


def _joined(batches):
    """Links of one task to a forest: each node with the smallest node it is joined with."""
    import numpy as np
    import pandas as pd

    frames = [f for f in batches if len(f)]
    if not frames:
        return
    ends = np.concatenate([f[["a", "b"]].to_numpy(dtype=np.int64) for f in frames])
    nodes, at = np.unique(ends, return_inverse=True)
    a, b = at.reshape(-1, 2).T
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        for end in (a, b):
            np.minimum.at(new, end, low)
            np.minimum.at(new, root[end], low)
        new = new[new]
        if (new == root).all():
            break
        root = new
    yield pd.DataFrame({"node": nodes, "root": nodes[root]})


def components(links: DataFrame, count: int, per_task: int = LINKS_PER_TASK) -> DataFrame:
    """``node, root`` for every node of ``links`` (a, b: long); the root is its component's smallest node.

    ``count`` is the number of links.  Each task first joins its own share of them, so what is
    left is at most a row per node and task; where there are several tasks, stars then grow over
    the tasks' forests by joins, hubs split, until nothing changes.
    """
    tasks = max(1, -(-count // per_task))
    forest = links.select("a", "b").repartition(tasks).mapInPandas(_joined, "node long, root long")
    if tasks == 1:
        return forest
    nodes, seen = written(forest, "forest", links=F.count_if(F.col("node") != F.col("root")))
    edges = nodes.where("node <> root").select(F.col("node").alias("u"), F.col("root").alias("v")).distinct()
    state = None
    while seen["links"]:
        # Every larger neighbour of a node moves to the smallest node around it.
        around = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = split_join(around, low, ["u"]).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # Then a node's smaller neighbours, and itself, move to the smallest of them.
        small_low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = split_join(large, small_low, ["u"]).where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        moved = small.union(small_low.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        digest = F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))
        edges, seen = written(moved, "stars", links=F.count(F.lit(1)), digest=digest)
        if (seen["links"], seen["digest"]) == state:
            break
        state = (seen["links"], seen["digest"])
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    every = nodes.select("node").distinct()
    return every.join(shuffled(roots), "node", "left").select("node", F.coalesce("root", "node").alias("root"))
