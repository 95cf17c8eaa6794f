"""Connected components of an edge table by least labels, in Spark rounds."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quarry.llm.common import settle


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """``node, root`` for every end of ``edges`` (``u, v``): root is the least node reachable.

    Each round takes the least label among neighbours and then jumps to the label's own label, so long chains shrink by
    halves. Labels are settled each round; a hub's labels are combined before they are shuffled. An empty edge table
    gives no rows; loops and repeated edges change nothing.
    """
    both = settle(edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct(), "edges")
    labels = settle(both.groupBy("u").agg(F.min("v").alias("v")).select(F.col("u").alias("node"), F.least("u", "v").alias("root")), "labels")
    for _ in range(max_rounds):
        near = both.join(labels, F.col("v") == F.col("node")).groupBy("u").agg(F.min("root").alias("near"))
        least = labels.join(near, F.col("node") == F.col("u")).select("node", F.col("root").alias("old"), F.least("root", "near").alias("root"))
        jump = labels.select(F.col("node").alias("at"), F.col("root").alias("next"))
        moved = settle(least.join(jump, F.col("root") == F.col("at")).select("node", "old", F.least("root", "next").alias("root")), "labels")
        labels = moved.select("node", "root")
        if moved.where("root <> old").isEmpty():
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
