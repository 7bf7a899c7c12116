"""Extraction triage, classified pages and the links they leave to explore."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .eligibility import mapped
from .records import last_wins

# Routing of page types.
NEXT_ACTION = {
    "job_detail": "extract_jobs", "job_listing": "fetch_detail_links", "role_list_without_jd": "find_detail_pages_for_role_titles",
    "recruitment_program": "open_portal_and_find_job_detail_pages", "career_home": "open_portal_and_find_job_detail_pages", "apply_portal": "open_portal_and_find_job_detail_pages",
    "access_or_interactive_page": "retry_with_browser_or_rendered_collection", "document_or_brochure": "manual_review", "irrelevant": "skip_until_more_context", "uncertain": "manual_review",
}
KIND = dict.fromkeys(("job_listing", "apply_portal", "recruitment_program", "career_home", "role_list_without_jd"), "navigation_required") | {"access_or_interactive_page": "recovery_required", "irrelevant": "ignore"}
PRIORITY = {"job_listing": 80, "apply_portal": 80, "role_list_without_jd": 80, "recruitment_program": 75, "career_home": 60, "document_or_brochure": 60, "access_or_interactive_page": 60, "irrelevant": 20}
# Errors after which a page is worth another try.
PENDING_ERRORS = "403|forbidden|429|too many requests|timed out|timeout|winerror 10013"


def route_types(pages: DataFrame, page_type: str = "page_type") -> DataFrame:
    t = F.col(page_type)
    return pages.withColumns({"next_action": mapped(t, NEXT_ACTION), "pending_kind": F.coalesce(mapped(t, KIND), F.lit("review_required")), "priority": F.coalesce(mapped(t, PRIORITY), F.lit(50)).cast("int")})


def followup_rows(pages: DataFrame, kind: Column, action: Column, priority: Column, reasons: Column, stage: str) -> DataFrame:
    """Pages that need another step as follow-ups: what is known of the page, why and how to go on, and its telling links."""
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    links = F.transform("important_links", lambda x: F.struct(x["url"].alias("url"), x["text"].alias("text"), x["kind"].alias("kind")))
    return pages.select(
        "url", "final_url", "title", F.coalesce(F.nullif("source_name", F.lit("")), host).alias("source_name"), F.col("source_company_name").alias("company_name"), "company_type", "is_official",
        kind.alias("pending_kind"), reasons.alias("reasons"), action.alias("suggested_next_action"), priority.cast("int").alias("priority"), links.alias("links"), F.lit(stage).alias("stage"),
    )


def classified_followups(pages: DataFrame, page_type: str = "page_type", reasons: str = "reasons") -> DataFrame:
    """Follow-ups of classified pages that are no job's own page; without reasons of the classifier the route is the reason."""
    routed = route_types(pages.where(F.col(page_type) != "job_detail"), page_type)
    why = F.when(F.coalesce(F.size(reasons), F.lit(0)) > 0, F.col(reasons)).otherwise(F.array(F.concat(F.lit("page routed as "), page_type)))
    return followup_rows(routed, F.col("pending_kind"), F.col("next_action"), F.col("priority"), why, "pre_extraction")


def failed_followups(pages: DataFrame, error: str = "error") -> DataFrame:
    """Pages whose analysis failed, for a person to look at."""
    return followup_rows(pages, F.lit("review_required"), F.lit("manual_review"), F.lit(50), F.array(error), "pre_extraction")


def merged_followups(prior: DataFrame, new: DataFrame, order: str = "ord") -> DataFrame:
    """Follow-ups of both tables, new after prior ones: per address, kind and stage the last, at the place of the first."""
    both = prior.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    return last_wins(both.withColumn("_at", F.struct("_new", order)), ["url", "pending_kind", "stage"], "_at").drop("_new", "_at")


def fetch_error_route(error: Column) -> Column:
    return F.when(F.lower(error).rlike(PENDING_ERRORS), "pending").otherwise("rejected")


def extraction_triage(pages: DataFrame, records: DataFrame, page: str) -> DataFrame:
    """Per page what its records are worth, and the rule that asks for more discovery (``rule`` null: none does).

    ``pages``: ``page``, has_links; ``records``: ``page``, title, description, requirements, has_location, apply_url.
    Repeated titles are counted in two steps, so neither a page nor a title gathers lists.
    """
    empty = lambda c: F.coalesce(F.col(c) == "", F.lit(True))
    titles = records.where(~empty("title")).groupBy(page, "title").agg(F.count("*").alias("_c")).groupBy(page).agg(F.sum(F.col("_c") - 1).alias("duplicate_title_count"))
    urls = records.where(~empty("apply_url")).groupBy(page, "apply_url").agg(F.count("*")).groupBy(page).agg(F.count("*").alias("unique_apply_url_count"))
    n = records.groupBy(page).agg(
        F.count("*").alias("extracted_job_count"), F.count_if(empty("description")).alias("missing_description_count"), F.count_if(empty("requirements")).alias("missing_requirements_count"),
        F.count_if(~F.col("has_location")).alias("missing_location_count"), F.count_if(empty("description") & empty("requirements")).alias("_sparse"),
    )
    told = pages.join(n, page, "left").join(titles, page, "left").join(urls, page, "left").fillna(0)
    jobs, links = F.col("extracted_job_count"), F.col("unique_apply_url_count")
    ratio = F.coalesce(F.try_divide(F.col("_sparse").cast("double"), jobs), F.lit(0.0))
    rule = (
        F.when(jobs == 0, "no_records").when((jobs >= 10) & (ratio >= 0.75), "many_sparse").when((jobs >= 2) & (ratio >= 0.8) & ((links > 0) | F.col("has_links")), "sparse_with_links")
        .when((jobs >= 10) & (links <= 1) & (F.col("missing_description_count") >= jobs * 0.5), "shared_apply_url")
    )
    kind = F.when(F.col("rule") == "no_records", "review_required").when(F.col("rule").isNotNull(), "navigation_required")
    priority = mapped(F.col("rule"), {"no_records": 60, "many_sparse": 80, "sparse_with_links": 80, "shared_apply_url": 75}).cast("int")
    return told.withColumn("sparse_record_ratio", F.round(ratio, 3)).withColumn("rule", rule).withColumn("pending_kind", kind).withColumn("priority", priority).drop("_sparse")


def explore(followups: DataFrame, excluded: DataFrame, explored: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(new sources, report per follow-up) of ``followups`` (fu, priority, pending_kind, links: ord, url_key, text).

    Links of several follow-ups to one address count for the first; ``excluded`` and ``explored`` hold ``url_key``.
    """
    rows = followups.where("pending_kind = 'navigation_required'").select("fu", "priority", F.explode("links").alias("l")).select("fu", "priority", "l.ord", "l.url_key", "l.text")
    barred = excluded.select("url_key").unionByName(explored.select("url_key")).where("url_key is not null").distinct().withColumn("_barred", F.lit(True))
    told = rows.where("url_key is not null").join(barred, "url_key", "left").withColumn("_nth", F.row_number().over(Window.partitionBy("url_key").orderBy("fu", "ord")))
    told = told.unionByName(rows.where("url_key is null"), allowMissingColumns=True)
    state = F.when(F.col("url_key").isNull(), "invalid").when(F.col("_barred").isNotNull() | (F.col("_nth") > 1), "skipped").otherwise("discovered")
    told = told.withColumn("state", state)
    sources = told.where("state = 'discovered'").select("fu", "ord", F.col("url_key").alias("url"), F.coalesce(F.nullif(F.trim("text"), F.lit("")), "url_key").alias("title"), F.col("priority").alias("relevance_score"), "text")
    counts = told.groupBy("fu").agg(*(F.count_if(F.col("state") == s).alias(s) for s in ("discovered", "skipped", "invalid")))
    report = followups.select("fu").join(counts, "fu", "left").fillna(0)
    status = F.when(F.col("discovered") + F.col("skipped") == 0, "no_usable_links").when(F.col("discovered") > 0, "explored").otherwise("already_explored")
    return sources, report.withColumn("status", status).withColumn("skipped", F.col("skipped") + F.when(status == "no_usable_links", 0).otherwise(F.col("invalid")))


def candidate_sources(found: DataFrame, followups: DataFrame) -> DataFrame:
    """New sources of :func:`explore` with what their follow-up knows: label, else its title, else the address; source, company, priority, and where the link was.

    ``followups``: fu, url, title, source_name, company_name, company_type, is_official, priority, pending_kind.
    """
    known = followups.select("fu", F.col("url").alias("_from"), F.col("title").alias("_title"), "source_name", "company_name", "company_type", "is_official", F.col("priority").alias("_priority"), "pending_kind")
    why = F.concat(F.lit("href from follow-up "), "_from", F.when(F.coalesce("pending_kind", F.lit("")) != "", F.concat(F.lit(" ("), "pending_kind", F.lit(")"))).otherwise(""))
    title = F.coalesce(F.nullif(F.trim("text"), F.lit("")), F.nullif("_title", F.lit("")), "url")
    return found.join(known, "fu").select("fu", "ord", "url", title.alias("title"), "source_name", "company_name", "company_type", "is_official", F.col("_priority").alias("relevance_score"), why.alias("reason"))
