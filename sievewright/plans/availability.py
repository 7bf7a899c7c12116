"""Which actions a state allows, and why not."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import all_reasons

ACTIONS = ("build_search_plan", "web_search", "acquire_page", "analyze_page", "job_extraction", "explore_followups", "job_understanding", "match_analysis", "stop")
#: Actions with a backlog: the state's columns of artifacts and of pending ones.
WORK = {
    "acquire_page": ("acquisition_queue", "pending_acquire_page"), "analyze_page": ("acquired_pages", "pending_analyze_page"), "job_extraction": ("job_detail_pages", "pending_job_extraction"),
    "explore_followups": (None, "pending_explore_followups"), "job_understanding": ("prepared_jobs", "pending_job_understanding"), "match_analysis": ("understanding_records", "pending_match_analysis"),
}
COLUMNS = (
    "stopped boolean, has_plan boolean, has_profile boolean, open_queries int, search_rounds int, max_search_rounds int, last_search string, candidate_sources int, acquisition_queue int, "
    "acquired_pages int, job_detail_pages int, prepared_jobs int, understanding_records int, match_assessments int, errors int, max_results int, soft_target int, "
    + ", ".join(f"{p} int" for _, p in WORK.values())
)


def stop_evidence() -> Column:
    """Anything that lets a run end."""
    c = F.col
    productive = sum((c(p) for _, p in WORK.values()), F.lit(0)) > 0
    may_search = (c("search_rounds") < c("max_search_rounds")) & ((c("has_plan") & (c("open_queries") > 0)) | (~c("has_plan") & (c("errors") == 0)))
    return (
        (c("prepared_jobs") >= c("max_results")) | c("last_search").isin("error", "stopped_no_progress") | (~c("has_plan") & (c("candidate_sources") == 0) & (c("acquisition_queue") == 0))
        | ((c("acquired_pages") == 0) & (c("job_detail_pages") == 0) & (c("prepared_jobs") == 0) & (c("errors") > 0))
        | ((c("match_assessments") >= c("soft_target")) & ~productive) | (~productive & ~may_search)
    )


def action_table(states: DataFrame, calls: DataFrame | None = None, key: str = "state") -> DataFrame:
    """A row per state and action: ``reasons`` against it and ``available``.

    ``states`` has the columns in COLUMNS; ``calls`` (state, action, used, allowed) bounds single actions.
    """
    rows = states.withColumn("action", F.explode(F.array(*map(F.lit, ACTIONS))))
    if calls is not None:
        rows = rows.join(calls, [key, "action"], "left")
    else:
        rows = rows.withColumns({"used": F.lit(None).cast("int"), "allowed": F.lit(None).cast("int")})
    c, a = F.col, F.col("action")
    plan_open = c("has_plan") & (c("open_queries") > 0)
    checks = [
        ((a != "stop") & c("stopped"), "state is already stopped"),
        (c("used") >= c("allowed"), F.concat(F.lit("action call limit reached ("), c("used").cast("string"), F.lit("/"), c("allowed").cast("string"), F.lit(")"))),
        ((a == "web_search") & ~c("has_plan"), "search_plan is missing"),
        ((a == "web_search") & (c("search_rounds") >= c("max_search_rounds")), "max_search_rounds reached"),
        ((a == "web_search") & c("has_plan") & (c("open_queries") == 0), "all search-plan queries are already executed"),
        (a.isin("build_search_plan", "job_extraction") & ~c("has_profile"), F.concat(F.lit("profile is required by "), a)),
        ((a == "build_search_plan") & plan_open, "current search plan is still active"),
        ((a == "build_search_plan") & F.coalesce(c("last_search") == "error", F.lit(False)), "previous Tavily search failed"),
        ((a == "build_search_plan") & F.coalesce(c("last_search") == "stopped_no_progress", F.lit(False)), "no-progress stop condition reached"),
    ]
    ended = {"analyze_page": "all acquired_pages are already processed", "job_extraction": "all job_detail_pages are already extracted", "job_understanding": "all prepared_jobs are already understood", "match_analysis": "all understanding_records are already matched"}
    for name, (artifacts, pending) in WORK.items():
        if artifacts:
            checks.append(((a == name) & (c(artifacts) == 0), f"{artifacts} is empty"))
        if name in ended:
            checks.append(((a == name) & (c(artifacts) > 0) & (c(pending) == 0), ended[name]))
    checks += [
        ((a == "job_extraction") & (c("prepared_jobs") >= c("max_results")), "max_results reached"),
        ((a == "explore_followups") & (c("pending_explore_followups") == 0), "no unresolved navigation followup has a new executable href"),
        ((a == "match_analysis") & ~c("has_profile"), "profile is required by match_analysis"),
        ((a == "stop") & c("stopped"), "state is already stopped"),
        ((a == "stop") & ~F.coalesce(stop_evidence(), F.lit(False)), "no deterministic stop condition is present"),
    ]
    return rows.withColumn("reasons", all_reasons(*checks)).withColumn("available", F.size("reasons") == 0)
