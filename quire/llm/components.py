"""Connected components of a link table by min-label propagation with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quire.llm.common import drop_written, written


def components(links: DataFrame) -> DataFrame:
    """(node, label) for every end of links (a, b): label is the smallest node of its component.

    Each round takes the least label among a node and its neighbours, then the label's own label, so the rounds grow
    with the logarithm of a component's width. Every round's labels are a written table: lineage stays short and a
    lost executor costs no earlier round. No links give an empty table.
    """
    edges = written(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    labels = written(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("label")).select(F.col("a").alias("node"), "label"), "labels")
    while True:
        near = edges.join(labels.select(F.col("node").alias("b"), F.col("label").alias("to")), "b").groupBy("a").agg(F.min("to").alias("to"))
        least = labels.join(near, labels.node == near.a).select("node", "label", F.least("label", "to").alias("new"))
        jump = labels.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        after = written(least.join(jump, "new").select("node", F.least("new", "jump").alias("label"), (F.least("new", "jump") != F.col("label")).alias("moved")), "labels")
        moving = not after.where("moved").isEmpty()
        drop_written(labels)
        labels = after.select("node", "label")
        if not moving:
            drop_written(edges)
            return labels
