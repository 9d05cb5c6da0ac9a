"""Connected components of an undirected edge list, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.util import cut


def components(edges: DataFrame) -> DataFrame:
    """edges(a, b), a <> b, no nulls: node, root for every node of an edge; root is the least node of its component.

    In each round a node's root becomes the least root beside it, and then that root's own; the root that was left learns
    of it, too, so that chains halve. Rounds end when nothing changes, and roots only fall, so that they do end. A round is
    one table in the shared folder. A node of many edges is combined before the shuffle.
    """
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).distinct(), "edges")
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("m")).select("node", F.least("node", "m").alias("root")), "labels")
    while True:
        beside = both.join(labels, both["b"] == labels["node"]).select("a", "root").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("near"))
        hooked = labels.join(beside, "node").select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        better = hooked.where("root < old").groupBy(F.col("old").alias("node")).agg(F.min("root").alias("found"))
        told = hooked.join(better, "node", "left").select("node", "old", F.least("root", F.coalesce("found", "root")).alias("root"))
        above = labels.select(F.col("node").alias("root"), F.col("root").alias("above"))
        new = cut(told.join(above, "root", "left").select("node", "old", F.least("root", F.coalesce("above", "root")).alias("root")), "labels")
        labels = new.select("node", "root")
        if not new.where("root <> old").limit(1).count():
            return labels
