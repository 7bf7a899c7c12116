"""Bounded first-seen admission of sources, and what is still to do."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..plans.numbering import numbered


def admit(inputs: DataFrame, queued: DataFrame, handled: DataFrame, key: str = "url_key", order: str = "ord", limit: int | None = None) -> DataFrame:
    """``inputs`` with ``outcome``: invalid, handled, duplicate, limited or admitted.

    ``key`` is null for invalid inputs; ``queued`` and ``handled`` hold keys in their column ``key``. Keys are ranked by
    first sight; of the new ones the first ``limit`` are admitted. A repeat is a duplicate only if its first sight was
    admitted, else it is limited too. The only rows that meet in one task are those of one key and, where there is a
    limit, the ``limit`` smallest first sights.
    """
    flag = lambda df, name: df.select(F.col(key)).where(F.col(key).isNotNull()).distinct().withColumn(name, F.lit(True))
    told = inputs.join(flag(handled, "_handled"), key, "left").join(flag(queued, "_queued"), key, "left")
    new = F.col(key).isNotNull() & F.col("_handled").isNull() & F.col("_queued").isNull()
    # Invalid inputs are not ranked, so they do not meet.
    seen = told.where(F.col(key).isNotNull()).withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(order))).unionByName(told.where(F.col(key).isNull()).withColumn("_nth", F.lit(1)))
    if limit is None:
        picked = seen.withColumn("_in", new)
    else:
        firsts = seen.where(new & (F.col("_nth") == 1)).select(F.col(key), order).orderBy(order).limit(max(0, limit)).select(F.col(key), F.lit(True).alias("_take"))
        picked = seen.join(F.broadcast(firsts) if limit <= 10_000 else firsts, key, "left").withColumn("_in", new & F.coalesce("_take", F.lit(False)))
    outcome = (
        F.when(F.col(key).isNull(), "invalid").when(F.col("_handled").isNotNull(), "handled").when(F.col("_queued").isNotNull(), "duplicate")
        .when(~F.col("_in"), "limited").when(F.col("_nth") > 1, "duplicate").otherwise("admitted")
    )
    return picked.withColumn("outcome", outcome).select(*inputs.columns, "outcome")


def admission_counts(judged: DataFrame, queue_size: Column | int = 0) -> DataFrame:
    """One row of counters over the outcomes."""
    n = {x: F.count_if(F.col("outcome") == x) for x in ("admitted", "duplicate", "handled", "invalid", "limited")}
    return judged.agg(
        F.count("*").alias("input_count"), n["admitted"].alias("enqueued_count"), n["duplicate"].alias("duplicate_count"), n["handled"].alias("handled_count"),
        n["invalid"].alias("invalid_count"), n["limited"].alias("limited_count"), F.count_if(F.col("outcome") != "admitted").alias("skipped_count"),
        (n["admitted"] + (queue_size if isinstance(queue_size, Column) else F.lit(queue_size))).alias("queue_size_after_enqueue"),
    )


def backlog(artifacts: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Artifacts without a completion marker."""
    return artifacts.join(done.select(key), key, "left_anti")


def take_batch(pending: DataFrame, size: int, order: str, executable: Column | None = None) -> DataFrame:
    """The first ``size`` (executable) rows in order."""
    return (pending if executable is None else pending.where(executable)).orderBy(order).limit(max(0, size))


def quotas(queries: DataFrame, most: int, index: str = "idx") -> DataFrame:
    """``most`` results over all queries: equal parts, the remainder to the first ones (``index`` from 0)."""
    n = queries.agg(F.count("*").alias("_n"))
    return queries.crossJoin(F.broadcast(n)).withColumn("quota", F.expr(f"{most} div _n") + (F.col(index) < F.expr(f"{most} % _n")).cast("int")).drop("_n")


def searched(rows: DataFrame, most: int | None = None) -> DataFrame:
    """Search answers as sources: blank addresses go, the first of each identity stays, the first ``most`` of them where there is a limit.

    ``rows``: ord, title, url, url_key, content, score (0 to 1). A limit beyond a task's measure is taken by ranges.
    """
    held = F.struct(*(c for c in rows.columns if c != "url_key"))
    kept = rows.where(F.trim("url") != "").groupBy("url_key").agg(F.min_by(held, "ord").alias("_first")).select("_first.*")
    if most is not None:
        kept = kept.orderBy("ord").limit(most) if most <= 10_000 else numbered(kept, "ord").where(F.col("row_no") <= most)
    return as_sources(kept)


def as_sources(answers: DataFrame) -> DataFrame:
    """Every answer (ord, title, url, content, score) as a source: its address where it has no title, a score of 0 to 100, the first 1,000 characters as reason."""
    return answers.select("ord", "url", F.coalesce(F.nullif("title", F.lit("")), "url").alias("title"), F.round(F.col("score") * 100).cast("int").alias("relevance_score"), F.substring("content", 1, 1000).alias("reason"))


def enabled_sources(rows: DataFrame) -> DataFrame:
    """Configured sources: only those that say they are enabled stay; title and source name fall back to name, then address; the score to 100."""
    keys = [c for c in ("ord",) if c in rows.columns]
    return rows.where(F.coalesce("enabled", F.lit(False))).select(*keys, "url", F.coalesce("title", "name", "url").alias("title"), F.coalesce("name", "url").alias("source_name"), F.coalesce("relevance_score", F.lit(100)).alias("relevance_score"))
