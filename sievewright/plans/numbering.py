"""Running numbers over a whole table without a global sort in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..session import stored


def numbered(rows: DataFrame, *order: str, per_range: int = 1_000_000) -> DataFrame:
    """``rows`` with ``row_no`` from 1 in the order of the columns ``order``, whose values together are expected to be unique.

    The input is worked out once (persisted while its ranges are made), exchanged and sorted once by ranges of about
    ``per_range`` rows, and stored with each row's range and place in it. Counts of the ranges, summed up in order, are
    what comes before each; of them there are as many as ranges. Bounds decide how even ranges are, not the numbers.
    """
    held = rows.persist()
    ranges = max(1, -(-held.count() // per_range))
    at = F.monotonically_increasing_id()  # the partition's number above 33 bits of the place in it
    placed = stored(held.repartitionByRange(ranges, *order).sortWithinPartitions(*order).withColumn("_at", at), "numbered")
    held.unpersist()
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    sizes = placed.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    inside = F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.join(F.broadcast(before), "_range").withColumn("row_no", F.col("_before") + inside + 1).drop("_range", "_at", "_before")
