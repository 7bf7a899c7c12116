"""Sinks: JSON artifacts, the jobs table, CSV for a person."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.records import fit_for_table, upsert_counted


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def replace_table(df: DataFrame, path: str, version: int) -> str:
    """Write a new version beside the old one, as a table cannot be rewritten while it is read; returns its path."""
    where = f"{path}/version={version}"
    df.write.mode("overwrite").parquet(where)
    return where


def rejected(rows: DataFrame, required: tuple[str, ...] = ("company_name", "source_name")) -> tuple[DataFrame, DataFrame]:
    """(rows fit for the table, rows that lack a column it requires)."""
    good, refused = fit_for_table(rows, list(required))
    return good, refused.drop("reason")


def csv_for_download(df: DataFrame, path: str, most: int = 100_000) -> None:
    """One CSV file with a byte order mark, as spreadsheets want it; a person's grid, so more than ``most`` rows are refused."""
    lists = [f.name for f in df.schema if f.dataType.simpleString().startswith("array")]
    rows = df.withColumns({c: F.array_join(c, ",") for c in lists}).drop("id").limit(most + 1).toPandas()
    if len(rows) > most:
        raise ValueError(f"more than {most} rows: use write_csv")
    rows.to_csv(path, index=False, encoding="utf-8-sig")


#: Columns of the jobs table that only its user or the first insert sets.
PRESERVED = ("status", "notes", "first_seen_at", "created_at")


def persist_jobs(old: DataFrame, jobs: DataFrame, path: str, version: int, order: str | None = None) -> dict:
    """Upsert a run's final jobs into the stored table; returns counts of inserted, updated and failed rows.

    Scores are no part of the table. Rows without key, company or source name are refused and counted. The whole table
    is written anew; :mod:`sievewright.sources.buckets` rewrites only what a batch touches.
    """
    table, _, counts = upsert_counted(old, jobs, "deduplication_key", [c for c in PRESERVED if c in old.columns], ["company_name", "source_name"], order)
    told = counts.first().asDict()
    replace_table(table.drop("action", "rows_seen"), path, version)
    return told


def write_csv(df: DataFrame, path: str) -> None:
    """The edited grid as CSV with a header; ``id`` stays behind. Spark writes no byte order mark."""
    lists = [f.name for f in df.schema if f.dataType.simpleString().startswith("array")]
    df.withColumns({c: F.array_join(c, ",") for c in lists}).drop("id").write.mode("overwrite").option("header", True).option("escape", '"').csv(path)
