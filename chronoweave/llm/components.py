"""Connected components of an edge table, wholly on the executors."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop, materialise

MAX_ROUNDS = 60


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b); root is the smallest node that it reaches.

    Each round lets every node point to its smallest neighbour (or itself), follows the pointers
    twice, and replaces the ends of all edges by what they point to. Edges inside one group vanish,
    so the table shrinks by a constant factor a round, also on long chains. Nothing is collected
    but counts. Rows with a null end are ignored; an empty table gives an empty result.
    """
    edges = materialise(edges.select("a", "b").where("a is not null and b is not null and a <> b").distinct())
    nodes = edges.select(F.col("a").alias("node")).union(edges.select(F.col("b").alias("node"))).distinct()
    roots = materialise(nodes.select("node", F.col("node").alias("root")))
    for _ in range(MAX_ROUNDS):
        if edges.limit(1).count() == 0:
            drop(edges)
            return roots
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        to = materialise(both.groupBy(F.col("a").alias("x")).agg(F.min("b").alias("m")).select("x", F.least("x", "m").alias("to")))
        for _ in range(2):
            nxt = to.select(F.col("x").alias("y"), F.col("to").alias("further"))
            old, to = to, materialise(to.join(nxt, F.col("to") == F.col("y")).select("x", F.col("further").alias("to")))
            drop(old)
        a, b = to.select(F.col("x").alias("a"), F.col("to").alias("ta")), to.select(F.col("x").alias("b"), F.col("to").alias("tb"))
        new = materialise(
            edges.join(a, "a").join(b, "b").select(F.least("ta", "tb").alias("a"), F.greatest("ta", "tb").alias("b")).where("a <> b").distinct()
        )
        up = to.select(F.col("x").alias("root"), F.col("to").alias("higher"))
        higher = materialise(roots.join(up, "root", "left").select("node", F.coalesce("higher", "root").alias("root")))
        drop(edges, to, roots)
        edges, roots = new, higher
    raise RuntimeError(f"components did not settle in {MAX_ROUNDS} rounds")
