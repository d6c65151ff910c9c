"""Connected components of links, with no join on a key that may be hot unsalted."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditlake.functions.scale import salted_lookup, stored


def connected(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node that each node of the (a, b) links is connected with.

    Each round a node takes the smallest label around it, the node of its old label learns
    of it, and labels are replaced by their own labels. A node with many links and a label
    of many nodes are looked up salted; minima are combined before they are exchanged.
    """
    links = links.where(F.col("a") != F.col("b"))
    both = stored(links.select("a", "b").unionByName(
        links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("b")).select(
        "node", F.least("node", "b").alias("label"))
    while True:
        labels = stored(labels)
        around = (
            salted_lookup(both, labels.select(F.col("node").alias("b"), "label"), ["b"], ["a"], "inner")
            .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        )
        met = stored(labels.join(around, "node").select(
            "node", F.col("label").alias("old"), F.least("label", "seen").alias("new")))
        heard = met.groupBy(F.col("old").alias("node")).agg(F.min("new").alias("heard"))
        hooked = stored(met.join(heard, "node", "left").select(
            "node", "old", F.least("new", "heard").alias("label")))
        jump = hooked.select(F.col("node").alias("label"), F.col("label").alias("further"))
        new = stored(salted_lookup(hooked, jump, ["label"], ["node"], "inner").select(
            "node", "old", F.col("further").alias("label")))
        labels = new.select("node", "label")
        if new.where(F.col("label") != F.col("old")).isEmpty():
            return labels
