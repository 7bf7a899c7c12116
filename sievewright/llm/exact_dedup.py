"""Exact dedup by progressive refinement: length, then prefix hash, then full hash (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Tables of up to so many rows (keys of 16 to 50 bytes each) are broadcast; larger ones are joined by exchange.
MOST_BROADCAST = 500_000


def _keys(text: Column, prefix_chars: int) -> tuple[Column, Column]:
    return F.octet_length(text).alias("_len"), F.xxhash64(F.substring(text, 1, prefix_chars)).alias("_prefix")


def survivors(docs: DataFrame, id_col: str, text_col: str, prefix_chars: int) -> DataFrame:
    """``_id``, ``_len``, ``_prefix``, ``_sha`` of the rows whose length and prefix hash occur again.

    Rounds one and two work on counts per (length, prefix), which are partial aggregates. While the repeated pairs are
    few enough to be broadcast, the semi join stands below the hash, so only survivors have their whole text hashed
    and no text is exchanged. Beyond that the hash is made before the exchange, as moving texts costs more than hashing.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    length, prefix = _keys(text, prefix_chars)
    cells = docs.select(length, prefix).groupBy("_len", "_prefix").agg(F.count("*").alias("_n"))
    by_len = cells.groupBy("_len").agg(F.sum("_n").alias("_all")).where("_all > 1").select("_len")
    repeated = stored(cells.join(by_len, "_len", "left_semi").where("_n > 1").select("_len", "_prefix"), "exact-prefixes")
    rows, sha = docs.select(F.col(id_col).alias("_id"), text.alias("_text"), length, prefix), F.sha2("_text", 256).alias("_sha")
    few = small(repeated, MOST_BROADCAST)
    if few is repeated:
        return rows.select("_id", "_len", "_prefix", sha).join(repeated, ["_len", "_prefix"], "left_semi")
    return rows.join(few, ["_len", "_prefix"], "left_semi").select("_id", "_len", "_prefix", sha)


def duplicate_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """Groups of two or more rows with identical text: ``text_sha256``, ``keep_id`` (largest id), ``group_size``; stored.

    Null text counts as empty; null ids never win over others (a group with null ids only has ``keep_id`` null). A
    group that holds a third of the rows reaches a reducer as one row per task.
    """
    rows = survivors(docs, id_col, text_col, prefix_chars)
    return stored(rows.groupBy(F.col("_sha").alias("text_sha256")).agg(F.max("_id").alias("keep_id"), F.count("*").alias("group_size")).where("group_size > 1"), "exact-groups")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """Each row of ``docs`` once with its decision; of equal texts the row with the largest id stays.

    Columns: ``doc_id``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``. Null text counts as empty. A row with
    a null id stays only if no row with an id has its text. Rows that repeat id and text are copies of one document:
    all of them name it as ``keep_id`` and carry its ``kept``. An empty table gives an empty result; further columns of
    ``docs`` are not read. The digest that every row carries is asked for by the caller; the groups do not need it.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    groups = small(duplicate_groups(docs, id_col, text_col, prefix_chars), MOST_BROADCAST)
    rows = docs.select(F.col(id_col).alias("doc_id"), F.sha2(text, 256).alias("text_sha256"))
    return rows.join(groups, "text_sha256", "left").select(
        "doc_id",
        F.when(F.col("group_size").isNull(), F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"),
        (F.col("group_size").isNull() | F.col("doc_id").eqNullSafe(F.col("keep_id"))).alias("kept"),
        "text_sha256",
    )


def keep_unique(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix_chars: int = 128) -> DataFrame:
    """The rows of ``docs``, all columns, that :func:`exact_dedup` keeps.

    Only survivors of the first two rounds have their whole text hashed. Dropped rows are named by id, length and
    prefix hash; a row with one of these names goes if its digest is the dropped one's as well.
    """
    held = stored(survivors(docs, id_col, text_col, prefix_chars), "exact-survivors")
    groups = held.groupBy("_sha").agg(F.max("_id").alias("_keep"), F.count("*").alias("_n")).where("_n > 1").select("_sha", "_keep")
    groups = small(stored(groups, "exact-groups"), MOST_BROADCAST)
    named = held.join(groups, "_sha").where(~F.col("_id").eqNullSafe(F.col("_keep"))).select(F.col("_id").alias("_out_id"), F.col("_len").alias("_out_len"), F.col("_prefix").alias("_out_prefix"), F.col("_sha").alias("_out_sha")).distinct()
    dropped = small(stored(named, "exact-dropped"), MOST_BROADCAST)
    text = F.coalesce(docs[text_col], F.lit(""))
    length, prefix = _keys(text, prefix_chars)
    name = docs[id_col].eqNullSafe(F.col("_out_id")) & (length == F.col("_out_len")) & (prefix == F.col("_out_prefix"))
    # As a case, the digest is no join key: it is made for rows that bear a dropped one's name.
    return docs.join(dropped, name & F.when(F.sha2(text, 256) == F.col("_out_sha"), True).otherwise(False), "left_anti")
