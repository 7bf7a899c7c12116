"""Connected components over tables of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, stored


def components(links: DataFrame) -> DataFrame:
    """``id``, ``label`` (smallest id reachable) of every end of ``links`` (a, b).

    Labels spread to neighbours and then jump to their label's label, so paths shorten by half a round; every round is
    written to the shared folder. Nothing but the number of changes reaches the driver.
    """
    both = stored(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).where("a <> b").distinct(), "links")
    labels = stored(both.groupBy("a").agg(F.min("b").alias("b")).select(F.col("a").alias("id"), F.least("a", "b").alias("label")), "labels")
    held = labels
    while True:
        told = both.join(labels.select(F.col("id").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("_near"))
        near = labels.join(told.withColumnRenamed("a", "id"), "id").select("id", "label", F.least("label", "_near").alias("_new"))
        top = labels.select(F.col("id").alias("_new"), F.col("label").alias("_top"))
        step = stored(near.join(top, "_new", "left").select("id", F.col("label").alias("_old"), F.least("_new", F.coalesce("_top", "_new")).alias("label")), "labels")
        discard(held)
        held, labels = step, step.select("id", "label")
        if step.where("_old <> label").isEmpty():
            discard(both)
            return labels
