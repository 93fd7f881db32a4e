"""Connected components of a graph given as a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plantwatch.llm.common import cut_lineage


def components(links: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(node, comp) of every node of the links; comp is the smallest node of its component.

    Each round takes the smallest label among the neighbours and then follows labels of labels, so that long chains need few
    rounds. Rounds are written to shared storage; no node or link reaches the driver.
    """
    both = links.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    both = cut_lineage(both.union(both.select("y", "x")).distinct())
    labels = cut_lineage(both.groupBy("x").agg(F.least(F.col("x"), F.min("y")).alias("label")))
    while True:
        offered = both.join(labels.withColumnRenamed("x", "y"), "y").groupBy("x").agg(F.min("label").alias("offer"))
        nearer = labels.join(offered, "x").select("x", "label", F.least("label", "offer").alias("next"))
        jump = labels.select(F.col("x").alias("next"), F.col("label").alias("far"))
        moved = nearer.join(jump, "next").select("x", F.least("next", "far").alias("new"), "label")
        moved = cut_lineage(moved)
        labels = moved.select("x", F.col("new").alias("label"))
        if moved.where("new <> label").isEmpty():
            return labels.select(F.col("x").alias("node"), F.col("label").alias("comp"))
