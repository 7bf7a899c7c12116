"""What a person is shown of a run: cards of results, the funnel, pages and queues without their payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .features import COSTS, readable, RECOMMENDATION_TEXTS

# The stages of a funnel and how they read.
FUNNEL = {
    "candidate_sources": "Candidate sources", "acquired_pages": "Acquired pages", "job_detail_pages": "Job detail pages", "prepared_jobs": "Prepared jobs",
    "understanding_records": "Understanding records", "match_assessments": "Match assessments",
}


def cards(assessments: DataFrame, jobs: DataFrame, key: str = "deduplication_key", most: int = 4) -> DataFrame:
    """A row per assessment: title and company of its job, else its own, else a stand-in; score, recommendation as text, the first reasons, where to apply.

    ``assessments``: key, title, company_name, match_score, recommendation, match_reasons, deterministic_reasons; of
    ``jobs``: key, title, company_name, apply_url, source_url, at most one row per key.
    """
    filled = lambda c: F.nullif(F.col(c), F.lit(""))
    mine = jobs.select(key, *(F.col(c).alias(f"_{c}") for c in ("title", "company_name", "apply_url", "source_url")))
    reasons = F.when(F.size("match_reasons") > 0, F.col("match_reasons")).otherwise(F.coalesce("deterministic_reasons", F.array().cast("array<string>")))
    return assessments.join(mine, key, "left").select(
        key, F.coalesce(filled("_title"), "title", F.lit("Untitled role")).alias("title"), F.coalesce(filled("_company_name"), "company_name", F.lit("Unknown company")).alias("company"),
        F.coalesce(F.concat(F.col("match_score").cast("string"), F.lit("/100")), F.lit("—")).alias("score"), readable(F.col("recommendation"), RECOMMENDATION_TEXTS, True).alias("recommendation"),
        F.slice(reasons, 1, most).alias("reasons"), F.coalesce(filled("_apply_url"), filled("_source_url")).alias("link"),
    )


def funnel(steps: DataFrame, *keys: str) -> DataFrame:
    """A row per state (``keys``) and stage of the funnel in its order: ``place``, ``stage``, ``n``; from its map ``counts``."""
    rows = F.array(*(F.struct(F.lit(k).alias("place"), F.lit(text).alias("stage"), F.coalesce(F.col("counts")[name], F.lit(0)).alias("n")) for k, (name, text) in enumerate(FUNNEL.items())))
    return steps.select(*keys, F.inline(rows))


def page_rows(pages: DataFrame) -> DataFrame:
    """Pages without their text: address, title, source, how they were fetched, and how long their parts are."""
    text = lambda c: F.coalesce(c, F.lit("")) if c in pages.columns else F.lit("")
    size = lambda c: F.coalesce(F.length(c), F.lit(0)) if c in pages.columns else F.lit(0)
    return pages.select(text("url").alias("url"), text("title").alias("title"), text("source_name").alias("source_name"), text("fetch_method").alias("acquisition_method"), size("html").alias("html_length"), size("visible_text").alias("visible_text_length"))


def backlog_rows(states: DataFrame, key: str, actions: tuple[str, ...]) -> DataFrame:
    """A row per state and batched action: pending, executable, batch size, how full a batch it makes, whether it can run, what it costs.

    ``states``: ``key``, stop_reason, and per action pending_, executable_ (the same where there is none) and batch_size_ of it.
    """
    def one(a: str):
        pending, size = F.col(f"pending_{a}").cast("long"), F.col(f"batch_size_{a}").cast("long")
        able = F.col(f"executable_{a}").cast("long") if f"executable_{a}" in states.columns else pending
        ratio = F.coalesce(F.try_divide(able.cast("double"), size), F.lit(0.0))
        return F.struct(F.lit(a).alias("action"), pending.alias("pending"), able.alias("executable"), size.alias("batch_size"), F.round(ratio, 2).alias("backlog_to_batch_ratio"), ((able > 0) & F.col("stop_reason").isNull()).alias("available"), F.lit(COSTS[a][0] > 0).alias("uses_llm"), F.lit(COSTS[a][1] >= 1).alias("uses_network"))

    return states.select(key, F.inline(F.array(*map(one, actions))))


def history_rows(steps: DataFrame, tables: tuple[str, ...]) -> DataFrame:
    """Steps of a run without their tables: step and the one before, what was done, why it ended, rows of ``tables``."""
    return steps.select("step", F.when(F.col("step") >= 0, F.col("step") - 1).alias("parent"), "action", F.coalesce("outcome", "status").alias("outcome"), F.when(F.col("action") == "stop", F.col("why")).otherwise("").alias("stop_reason"), *(F.coalesce(F.col("counts")[t], F.lit(0)).alias(t) for t in tables))
