"""Connected components by joins and map-side combined minima, each round cut by a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import store


def connected(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for the nodes of ``edges (src, dst)``; ``root`` is the smallest node reachable.

    Every round a node looks at its neighbours' roots, hooks its own root under the smallest and halves its path
    to the root, so the rounds grow with the logarithm of the longest path. Nodes of many links cost one combined
    row per task; joins have the node's one row on the other side, which adaptive execution can split.
    """
    links = edges.unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    links = store(links.filter("src <> dst").distinct(), "links")
    roots = store(links.select(F.col("src").alias("node")).distinct().withColumn("root", F.col("node")), "roots")
    while True:
        seen = roots.select(F.col("node").alias("dst"), F.col("root").alias("seen"))
        best = store(links.join(seen, "dst").groupBy(F.col("src").alias("node")).agg(F.min("seen").alias("best")), "roots-seen")
        met = roots.join(best, "node")
        hooks = store(met.groupBy(F.col("root").alias("node")).agg(F.min("best").alias("hook")), "roots-hooks")
        hooked = store(
            met.join(hooks, "node", "left").select("node", F.least("root", "best", F.coalesce("hook", "best")).alias("root")),
            "roots-hooked",
        )
        above = hooked.select(F.col("node").alias("root"), F.col("root").alias("above"))
        closer = store(hooked.join(above, "root").select("node", F.col("above").alias("root")), "roots-closer")
        moved = closer.join(roots.withColumnRenamed("root", "was"), "node").filter("root <> was")
        roots = closer
        if moved.isEmpty():
            return roots
