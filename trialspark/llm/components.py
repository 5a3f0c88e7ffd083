"""Connected components by contraction, for graphs that only a cluster holds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .common import store


def components(edges: DataFrame) -> DataFrame:
    """``a, b`` (long, undirected) to ``node, root``: one row per linked node.

    Each round points every node at its smallest neighbour, follows two such
    steps, renames the edges and drops those inside one class, so the graph
    shrinks by more than half.  Rounds are stored, never kept in executors only.
    Joins look up tables with unique keys, so a hot key on the other side can be
    split.  Self-links and repeated edges do no harm; no edges give no rows.
    """
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    edges = store(both.where("a <> b").distinct(), "edges")
    labels = None
    while True:
        low = store(edges.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("up")), "low")
        top = low.select(F.col("a").alias("up"), F.col("up").alias("root"))
        top = store(low.join(top, "up").select("a", "root"), "top")
        if labels is None:
            labels = top.select(F.col("a").alias("node"), "root")
        else:
            names = top.select(F.col("a").alias("root"), F.col("root").alias("up"))
            labels = store(
                labels.join(names, "root", "left").select("node", F.coalesce("up", "root").alias("root")), "labels"
            )
        edges = (
            edges.join(top, "a").select(F.col("root").alias("c"), "b")
            .join(top.withColumnRenamed("a", "b"), "b").select(F.col("c").alias("a"), F.col("root").alias("b"))
        )
        edges = store(edges.where("a <> b").distinct(), "edges")
        if edges.isEmpty():
            return labels
