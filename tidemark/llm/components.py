"""Connected components as DataFrame jobs: least labels spread along links, with pointer jumping.

Every round is a written table in the shared folder, so a lost executor repeats one round at most. Nothing but
the number of changed labels reaches the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import stored


def connected_components(links: DataFrame) -> DataFrame:
    """(node, component) for the nodes of ``links(a, b)``; component is the least node that can be reached.

    Links are undirected and may repeat; a link of a node with itself makes it a node. Nulls are left out.
    """
    links = links.where("a is not null and b is not null")
    both = stored(links.select("a", "b").union(links.select(F.col("b"), F.col("a"))).distinct())
    labels = stored(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("label")))
    while True:
        seen = both.join(labels.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("seen"))
        lower = labels.join(seen, "node", "left").select("node", F.col("label").alias("old"), F.least("label", "seen").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        after = stored(lower.join(jump, "label", "left").select("node", "old", F.least("label", "next").alias("label")))
        labels = after.select("node", "label")
        if after.where("old <> label").isEmpty():
            return labels.withColumnRenamed("label", "component")
