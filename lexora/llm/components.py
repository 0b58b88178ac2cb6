"""Connected components of a link table, by hooking every node to its smallest neighbour and contracting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop, save


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of links (a, b); a component is named by its smallest node.

    Each round hooks nodes to smaller neighbours, follows the chains to their ends and replaces nodes by them.
    Every table is spread by node and saved, so a lost executor costs a stage and no round waits on a driver.
    """
    edges = save(links.where("a <> b").select(F.col("a").cast("long"), F.col("b").cast("long")).distinct(), "edges")
    labels = save(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("component", F.col("node")), "labels")
    while edges.limit(1).count():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        tree = save(both.groupBy("a").agg(F.min("b").alias("b")).where("b < a"), "tree")
        while True:
            up = tree.select(F.col("a").alias("up"), F.col("b").alias("top"))
            step = save(tree.join(up, tree["b"] == up["up"], "left").select("a", F.coalesce("top", "b").alias("b"), F.col("top").isNotNull().alias("moved")), "step")
            drop(tree)
            tree = step
            if not tree.where("moved").limit(1).count():
                break
            tree = tree.select("a", "b")
            tree._scratch_path = step._scratch_path
        to = tree.select(F.col("a").alias("node"), F.col("b").alias("root"))
        new = save(labels.join(to.withColumnRenamed("node", "component"), "component", "left").select("node", F.coalesce("root", "component").alias("component")), "labels")
        left, right = to.select(F.col("node").alias("a"), F.col("root").alias("ra")), to.select(F.col("node").alias("b"), F.col("root").alias("rb"))
        moved = edges.join(left, "a", "left").join(right, "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
        shrunk = save(moved.where("a <> b").distinct(), "edges")
        drop(edges, labels, tree)
        edges, labels = shrunk, new
    return labels
