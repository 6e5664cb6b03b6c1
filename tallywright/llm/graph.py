"""Connected components of a table of links, by minimum label with pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallywright.llm.store import stored


def components(links: DataFrame) -> DataFrame:
    """node, root (least node reachable) of every node in links(a, b).

    Each round stars every node's neighbourhood on the least label near it and then jumps to the
    label's own label, so chains halve. A round's labels are written down, and a label
    table with one row per linked node is all that is ever shuffled.
    """
    edges = stored(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "edges")
    label = stored(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "node"), "labels")
    while True:
        near = (edges.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node"))
                .agg(F.min("root").alias("near")))
        lower = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        # A root that a neighbour undercuts takes the lower label along for all its nodes.
        hooks = lower.where("low < root").groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        hooked = lower.join(hooks, "node", "left").select("node", "root", F.least("low", F.coalesce("hook", "low")).alias("low"))
        jump = hooked.select(F.col("node").alias("low"), F.col("low").alias("next"))
        after = stored(hooked.join(jump, "low", "left").select("node", F.coalesce("next", "low").alias("root"), (F.coalesce("next", "low") != F.col("root")).alias("moved")), "labels")
        if after.where("moved").isEmpty():
            return after.select("node", "root")
        label = after.select("node", "root")
