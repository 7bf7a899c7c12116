"""Backlogs that keep growing: a stream of artifacts worked off once each, micro-batch by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .admission import first_sights, keyed_state


def work_off(stream: DataFrame, key: str, path: str, work: Callable[[DataFrame], DataFrame], checkpoint: str) -> StreamingQuery:
    """Apply ``work`` to each new key once; results and markers go to ``path`` (results/batch=n, done/batch=n).

    Keyed state tells keys of earlier batches, so no marker is read again. Of the rows of a new key the smallest by hash
    is worked on, so a batch that is run again works on the same one, and overwrites its own output.
    """
    plain = [f"`{c.name}`" for c in stream.schema if "map<" not in c.dataType.simpleString()]
    tagged = first_sights(stream.withColumn("order_key", F.xxhash64(*plain)), key, "order_key")

    def step(batch: DataFrame, n: int) -> None:
        new = batch.where("first_before is null").groupBy(key).agg(F.min_by(F.struct(*(c for c in stream.columns if c != key)), "order_key").alias("_row") if len(stream.columns) > 1 else F.count("*").alias("_n"))
        new = (new.select(key, "_row.*") if len(stream.columns) > 1 else new.select(key)).select(*stream.columns).persist()
        work(new).write.mode("overwrite").parquet(f"{path}/results/batch={n}")
        new.select(key).write.mode("overwrite").parquet(f"{path}/done/batch={n}")
        new.unpersist()

    with keyed_state(stream.sparkSession):
        return tagged.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
