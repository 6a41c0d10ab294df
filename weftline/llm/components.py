"""Connected components of a table of links, by joins alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weftline.llm.staging import discard, scoped, stage


@scoped
def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that each node of ``links`` (a, b) reaches.

    Every round takes the smallest label among neighbours and then the label of that label, so that the number of rounds
    grows with the logarithm of the longest path for the most part. Labels are staged each round; nothing is collected but
    one count. Nodes without links are not in the result.
    """
    both = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = stage(both, "links", narrow=True)
    labels = stage(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("component")), "labels", narrow=True)
    while True:
        near = both.join(labels, both["b"] == labels["node"]).groupBy("a").agg(F.min("component").alias("near"))
        low = labels.join(near, labels["node"] == near["a"]).select("node", F.col("component").alias("old"), F.least("component", "near").alias("low"))
        up = labels.select(F.col("node").alias("n"), F.col("component").alias("top"))
        fresh = stage(low.join(up, low["low"] == up["n"]).select("node", F.col("top").alias("component"), (F.col("top") != F.col("old")).alias("moved")), "labels", narrow=True)
        discard(labels)
        labels = fresh
        if not labels.filter("moved").limit(1).count():
            return labels.select("node", "component")
