"""Connected components of an edge table, by hooking and contraction."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from krysalis.llm.common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for each node of ``edges(u long, v long)``; nodes of one component share a root.

    Each round every node hooks onto its neighbour of least hashed rank, if that
    is below its own, and the edges are rewritten to the hooks. Hashed ranks
    make any chain shrink by a constant factor a round whatever its ids, so the
    rounds grow with the logarithm of the graph. Each round's tables are written
    to the shared folder; nothing but the emptiness test reaches the driver.
    Loops and repeated edges change nothing; a node with loops only is absent,
    as are edges with a null end.
    """
    rest = materialize(edges.filter("u <> v").select("u", "v").distinct())
    hooks = []
    while not rest.isEmpty():
        both = rest.unionByName(rest.select(F.col("v").alias("u"), F.col("u").alias("v")))
        rank = lambda c: F.struct(F.xxhash64(c).alias("h"), F.col(c).alias("n"))
        least = both.groupBy("u").agg(F.min(rank("v")).alias("best"))
        hook = materialize(least.select(F.col("u").alias("node"), F.least(rank("u"), F.col("best"))["n"].alias("up")))
        hooks.append(hook)
        left = rest.join(hook.select(F.col("node").alias("u"), F.col("up").alias("a")), "u")
        moved = left.join(hook.select(F.col("node").alias("v"), F.col("up").alias("b")), "v").filter("a <> b")
        rest = materialize(moved.select(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).distinct())
    if not hooks:
        return edges.sparkSession.createDataFrame([], "node long, root long")

    def above(root: DataFrame, hook: DataFrame) -> DataFrame:
        top = root.select(F.col("node").alias("up"), "root")
        return materialize(hook.join(top, "up", "left").select("node", F.coalesce("root", "up").alias("root")))

    return reduce(above, reversed(hooks[:-1]), hooks[-1].select("node", F.col("up").alias("root")))
