"""Connected components of a graph of links, by minimum labels and pointer jumping over written tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .runtime import drop_written, written


def connected_components(links: DataFrame) -> DataFrame:
    """(id, label) of each vertex of ``links`` (a, b); the label is the smallest id of its component.

    A hub's messages are summed per task before they are shuffled. Labels halve their distance to the root
    each round, so the rounds grow with the logarithm of a component's width.
    """
    both = written(links.selectExpr("a src", "b dst").where("src <> dst").union(links.selectExpr("b src", "a dst").where("src <> dst")).groupBy("src", "dst").agg(F.lit(1).alias("one")).select("src", "dst"))
    labels = written(both.groupBy("src").agg(F.min("dst").alias("least")).selectExpr("src id", "least(src, least) label"))
    while True:
        heard = both.join(labels, F.col("src") == F.col("id")).select(F.col("dst").alias("id"), "label")
        spread = written(labels.withColumn("was", F.col("label")).unionByName(heard.withColumn("was", F.lit(None).cast("long"))).groupBy("id").agg(F.min("label").alias("label"), F.max("was").alias("was")))
        root = spread.selectExpr("id label", "label root")
        jumped = written(spread.join(root, "label", "left").selectExpr("id", "least(label, coalesce(root, label)) label", "was"))
        changed = jumped.where("label <> was").limit(1).count()
        drop_written(labels)
        drop_written(spread)
        labels = jumped.select("id", "label")
        if not changed:
            drop_written(both)
            return labels
