"""Connected components of a table of links, by Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrow import cut


def components(links: DataFrame) -> DataFrame:
    """node and comp, the smallest node reachable, for every node that is linked with another. Self links are allowed.

    Each round, every node hooks to its smallest neighbour (or is a root, if none is smaller), pointers are
    doubled until all stand at roots, and the links are carried over to the roots. A root with links has at
    least one other node below it, so the nodes that still have links halve each round at least, and rounds
    go on until no link is left; the smallest node of a component always stays a root. Each step is a table in
    the shared folder.
    """
    ends = lambda a, b: (F.least(a, b).alias("a"), F.greatest(a, b).alias("b"))
    edges = cut(links.where("a <> b").select(*ends("a", "b")).distinct(), "links")
    labels = None
    while labels is None or edges.limit(1).count():
        near = edges.select(F.col("a").alias("node"), F.col("b").alias("other")).union(edges.select("b", "a"))
        roots = cut(near.groupBy("node").agg(F.min("other").alias("other")).select("node", F.least("node", "other").alias("comp")), "roots")
        moved = True
        while moved:
            heads = roots.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            jumped = cut(roots.join(heads, "comp").select("node", F.col("top").alias("comp"), (F.col("top") != F.col("comp")).alias("moved")), "roots")
            moved = jumped.where("moved").limit(1).count() > 0
            roots = jumped.select("node", "comp")
        if labels is None:
            labels = roots
        else:
            above = roots.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
            labels = cut(labels.join(above, "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "labels")
        of = lambda side: roots.select(F.col("node").alias(side), F.col("comp").alias(f"root_{side}"))
        carried = edges.join(of("a"), "a").join(of("b"), "b").where("root_a <> root_b")
        edges = cut(carried.select(*ends("root_a", "root_b")).distinct(), "links")
    return labels
