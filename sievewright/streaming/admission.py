"""Admission of sources from a stream: keyed state holds first sights, so no batch reads what earlier ones left behind."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators import admission
from ..session import ready, stored

_PROVIDER = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@contextmanager
def keyed_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, on disk and by changes; the session's own setting comes back."""
    name, value = _PROVIDER
    before = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.unset(name) if before is None else spark.conf.set(name, before)


class FirstSights(StatefulProcessor):
    """Per key when it was first seen, or why it needed no sight; each row leaves with what was known before its batch.

    Column names must not begin with an underscore, as the frames that come in would lose them.

    Rows of a key come in parts of a bounded size and leave as they come, so a hot key is never held.
    """

    def __init__(self, order: str):
        self.order = order

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.held = handle.getValueState("held", "first long, was string")

    def handleInitialState(self, key: Any, initialState: pd.DataFrame, timerValues: Any) -> None:
        self.held.update((None, "handled" if (initialState["known_as"] == "handled").any() else "queued"))

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        first, was = self.held.get() if self.held.exists() else (None, None)
        least = None
        for part in rows:
            low = int(part[self.order].min())
            least = low if least is None else min(least, low)
            yield part.assign(first_before=pd.array([first] * len(part), "Int64"), was=was)
        if first is None and was is None and least is not None:
            self.held.update((least, None))

    def close(self) -> None:
        pass


def first_sights(stream: DataFrame, key: str, order: str, known: DataFrame | None = None) -> DataFrame:
    """``stream`` with ``first_before`` (``order`` of the key's first row in earlier batches; null: new) and ``was`` (handled or queued, from ``known``: key, ``known_as``)."""
    ready(stream.sparkSession)
    start = known.groupBy(key) if known is not None else None
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stream.schema)
    return stream.groupBy(key).transformWithStateInPandas(FirstSights(order), f"{kinds}, first_before long, was string", "Append", "None", initialState=start)


COUNTERS = "batch long, admitted long, cutoff long"


def _counters(spark: SparkSession, path: str, n: int) -> tuple[int, int | None]:
    """(keys admitted before batch ``n``, where admission ended; null while it goes on)."""
    try:
        last = spark.read.schema(COUNTERS).parquet(f"{path}/counters").where(F.col("batch") < n).orderBy(F.desc("batch")).limit(1).collect()
    except AnalysisException:
        last = []
    return (last[0]["admitted"], last[0]["cutoff"]) if last else (0, None)


def admit_stream(
    stream: DataFrame, path: str, checkpoint: str, key: str = "url_key", order: str = "ord", limit: int | None = None, queued: DataFrame | None = None, handled: DataFrame | None = None, then: Callable[[DataFrame, int], None] | None = None
) -> StreamingQuery:
    """Judge the rows of a stream as :func:`sievewright.operators.admission.admit` judges all of them at once; to ``path``/judged/batch=n.

    ``order`` is a whole number and grows from batch to batch. State keeps a key's first sight; beside it a batch reads one
    row of counters: how many keys were admitted, and where in the order admission ended. A later repeat is a duplicate
    if its first sight lies before that end, else it is limited as well. A batch that is run again writes the same.
    """
    spark = stream.sparkSession
    bare = F.concat(F.lit("\x00"), F.pmod(F.col(order), F.lit(64)).cast("string"))  # rows without a key are no group
    rows = stream.withColumn("group_key", F.coalesce(F.col(key), bare))
    flag = lambda df, was: df.select(F.col(key).alias("group_key"), F.lit(was).alias("known_as")).where("group_key is not null").distinct()
    known = [flag(df, was) for df, was in ((queued, "queued"), (handled, "handled")) if df is not None]
    tagged = first_sights(rows, "group_key", order, stored(known[0] if len(known) == 1 else known[0].unionByName(known[1]), "known-keys") if known else None)

    def step(batch: DataFrame, n: int) -> None:
        batch = batch.persist()
        admitted, cutoff = _counters(batch.sparkSession, path, n)
        new = F.col("first_before").isNull() & F.col("was").isNull()
        nothing = batch.where("false").select(key)
        fresh = batch.where(new | F.col(key).isNull()).select(*stream.columns)
        judged = admission.admit(fresh, nothing, nothing, key, order, None if limit is None else 0 if cutoff is not None else limit - admitted)
        later = F.when(F.col("was") == "handled", "handled").when(F.col("was") == "queued", "duplicate")
        later = later.when(F.lit(cutoff is None) | (F.col("first_before") <= F.lit(cutoff)), "duplicate").otherwise("limited")
        old = batch.where(~new & F.col(key).isNotNull()).withColumn("outcome", later).select(*stream.columns, "outcome")
        judged.unionByName(old).write.mode("overwrite").parquet(f"{path}/judged/batch={n}")
        told = batch.sparkSession.read.parquet(f"{path}/judged/batch={n}")
        count, top = told.where("outcome = 'admitted'").agg(F.count("*"), F.max(order)).first()
        full = limit is not None and admitted + count >= limit
        end = cutoff if cutoff is not None else (top if top is not None else -1 << 62) if full else None
        batch.sparkSession.createDataFrame([(n, admitted + count, end)], COUNTERS).coalesce(1).write.mode("overwrite").parquet(f"{path}/counters/at={n}")
        if then is not None:
            then(told, n)
        batch.unpersist()

    with keyed_state(spark):
        return tagged.writeStream.foreachBatch(step).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def judged(spark: SparkSession, path: str) -> DataFrame:
    """All rows judged so far."""
    return spark.read.parquet(f"{path}/judged").drop("batch")
