"""Connected components by lowest label and pointer jumping: only joins and sums by key, nothing collected."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marrow.llm.common import settled


#: A written table has a file for so many edges.
EDGES_A_FILE = 500_000


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the edges (a, b): root is the smallest node of its component."""
    both = settled(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    files = 1 + both.count() // EDGES_A_FILE

    labels = settled(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("low")).select("node", F.least("node", "low").alias("root")).coalesce(files), "labels")
    while True:
        # the lowest label among the neighbours, told to the own root as well, then the label of the label
        low = both.join(labels.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("low"))
        seen = labels.join(low, "node").select("node", "root", F.least("root", "low").alias("low"))
        seen = settled(seen.coalesce(files), "labels")
        told = seen.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("told"))
        met = seen.join(told, "node", "left").select("node", F.col("root").alias("old"), F.least("low", "told").alias("root"))
        above = met.select(F.col("node").alias("root"), F.col("root").alias("top"))
        labels = settled(met.join(above, "root", "left").select("node", "old", F.least("root", "top").alias("root")).coalesce(files), "labels")
        if not labels.where("root <> old").limit(1).count():
            return labels.select("node", "root")
