"""Connected components of a graph given as a table of edges."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.session import stage


def components(edges: DataFrame) -> DataFrame:
    """(node, component) for every node of ``edges(a, b)``; the component is its smallest node.

    Each round every label hooks onto the smallest label next to it, pointers are followed twice,
    and edges inside one label go.  Stars end after one round, chains shrink by a factor of four or more.
    Nothing is collected; every round is a written table, so a lost executor costs a retry only.
    """
    edges = stage(edges.filter("a <> b").distinct(), "edges")
    labels = None
    while not edges.isEmpty():
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = stage(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("up")), "hooks")
        for _ in range(2):
            above = hook.select(F.col("a").alias("up"), F.col("up").alias("top"))
            hook = stage(hook.join(above, "up", "left").select("a", F.coalesce("top", "up").alias("up")), "hooks")
        if labels is None:
            labels = hook.select(F.col("a").alias("node"), F.col("up").alias("component"))
        else:
            step = hook.select(F.col("a").alias("component"), "up")
            labels = labels.join(step, "component", "left").select("node", F.coalesce("up", "component").alias("component"))
            labels = stage(labels, "labels")
        one = edges.join(hook, "a").select(F.col("up").alias("a"), "b")
        two = one.join(hook.withColumnRenamed("a", "b"), "b").select("a", F.col("up").alias("b"))
        edges = stage(two.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges")
    if labels is None:
        labels = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    return labels
