"""What the scheduler sees: frontier, results, yields, deltas, scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .eligibility import mapped

# Costs of actions (model calls, network) and their order on ties.
COSTS = {
    "build_search_plan": (0.0, 0.5), "web_search": (0.0, 1.5), "acquire_page": (0.0, 1.0), "explore_followups": (0.0, 0.5), "analyze_page": (1.0, 0.0),
    "job_extraction": (1.0, 0.0), "job_understanding": (1.0, 0.0), "match_analysis": (1.0, 0.0), "stop": (0.0, 0.0),
}

TIES = ("match_analysis", "job_understanding", "job_extraction", "analyze_page", "explore_followups", "acquire_page", "web_search", "build_search_plan", "stop")


def histogram(rows: DataFrame, by: str) -> DataFrame:
    return rows.groupBy(by).agg(F.count("*").alias("n"))


def frontier(rows: DataFrame, priority: str, executable: Column, links: Column, high: int = 75) -> DataFrame:
    return rows.agg(F.count("*").alias("total"), F.count_if(executable).alias("executable"), F.avg(priority).alias("mean_priority"), F.max(priority).alias("max_priority"), F.count_if(executable & (F.col(priority) >= high)).alias("high_priority_executable"), F.sum(links).alias("usable_links"))


def frontier_features(rows: DataFrame, executable: str = "executable") -> DataFrame:
    """One row over follow-ups: counts, priorities, usable links, official ones, and how often each value of seven dimensions comes.

    ``rows``: pending_kind, suggested_next_action, stage, priority, is_official, links (addresses), page_type, confidence
    and the boolean ``executable``. Values are counted as rows of (dimension, value), so no dimension needs a pass of its
    own; null and empty ones do not count. An empty table gives zeros and empty maps.
    """
    dims = {"counts_by_pending_kind": "pending_kind", "counts_by_suggested_next_action": "suggested_next_action", "counts_by_stage": "stage", "priority_distribution": "priority", "semantic_type_counts": "page_type", "semantic_confidence_counts": "confidence"}
    each = rows.select(F.inline(F.array(*(F.struct(F.lit(k).alias("dim"), F.col(c).cast("string").alias("value")) for k, c in dims.items()))))
    counted = each.where("value <> ''").groupBy("dim", "value").agg(F.count("*").alias("n"))
    pairs = lambda k: F.map_from_entries(F.array_sort(F.collect_list(F.when(F.col("dim") == k, F.struct("value", "n"))))).alias(k)
    maps = counted.agg(*map(pairs, dims))
    able = F.coalesce(F.col(executable), F.lit(False))
    usable = F.size(F.filter(F.coalesce("links", F.array().cast("array<string>")), lambda x: x != ""))
    base = rows.agg(
        F.count("*").alias("pending_count"), F.count_if(able).alias("executable_count"), F.avg("priority").alias("mean_priority"), F.max("priority").alias("max_priority"), F.count_if(able & (F.col("priority") >= 75)).alias("high_priority_executable_count"),
        F.coalesce(F.sum(usable), F.lit(0)).alias("usable_link_count"), F.count_if("is_official").alias("official_count"), F.count_if(~F.coalesce("is_official", F.lit(False))).alias("non_official_count"),
    )
    return base.crossJoin(F.broadcast(maps))  # a row each


def result_features(assessments: DataFrame) -> DataFrame:
    """One row over assessments: jobs per recommendation, mean of the scores that are numbers, rows with flags, with missing requirements."""
    kinds = ("apply", "consider", "low_priority", "skip")
    filled = lambda c: F.count_if(F.coalesce(F.size(c), F.lit(0)) > 0)
    return assessments.agg(
        *(F.count_if(F.col("recommendation") == k).alias(f"{k}_count") for k in kinds), F.avg(F.expr("try_cast(match_score as double)")).alias("average_match_score"),
        filled("risk_flags").alias("risk_flagged_count"), filled("missing_requirements").alias("missing_requirement_count"),
    )


def goal_features(assessments: DataFrame, prepared: int | Column, target: int, most: int) -> DataFrame:
    """One row: assessments, useful ones among them, what is missing to the target, what the cap on prepared jobs leaves."""
    total = F.count("*")
    return assessments.agg(
        total.alias("total_match_assessments"), F.count_if(F.col("recommendation").isin("apply", "consider")).alias("useful_match_count"),
        F.greatest(F.lit(0), F.lit(target) - total).alias("result_deficit"), F.greatest(F.lit(0), F.lit(most) - (prepared if isinstance(prepared, Column) else F.lit(prepared))).alias("remaining_result_capacity"),
    )


def stage_report(rows: DataFrame, by: list[str], outcome: str, error: str, order: str | None = None, first: int = 20) -> DataFrame:
    """Rows, successes and failures per group, how often each error came (``errors``), and with ``order`` the first errors themselves.

    ``first_errors`` holds the ``first`` of a group's errors by ``order``, with it. Every task passes on no more than
    that many of a group, so a group that fails as a whole does not meet; the counts are exact whatever is listed.
    """
    base = rows.groupBy(*by).agg(F.count("*").alias("total"), F.count_if(outcome).alias("succeeded"), F.count_if(F.col(error).isNotNull()).alias("failed"))
    kinds = rows.where(F.col(error).isNotNull()).groupBy(*by, error).agg(F.count("*").alias("n"))
    listed = kinds.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col(error).alias("error"), "n"))).alias("errors"))
    told = base.join(listed, by, "left")
    if order is None:
        return told
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(order, error))
    heads = rows.where(F.col(error).isNotNull()).select(*by, order, error).withColumn("_n", rank).where(F.col("_n") <= first)
    heads = heads.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(F.col("_n").alias("n"), F.col(order).alias("at"), F.col(error).alias("error")))).alias("first_errors"))
    return told.join(heads, by, "left")


# How reasons of a stop and recommendations read.
STOP_TEXTS = {
    "max_results": "the hard result cap was reached", "max_steps": "the execution safety budget was exhausted", "no_progress": "no productive work remained",
    "frontier_exhausted": "the available work frontier was exhausted", "max_search_rounds": "the search-round expansion limit was reached", "max_rounds": "the search-round expansion limit was reached",
}
RECOMMENDATION_TEXTS = {"apply": "Apply", "consider": "Consider", "low_priority": "Low priority", "skip": "Skip"}


def readable(code: Column, texts: dict[str, str], title: bool = False) -> Column:
    """The text of a code; a code without one is shown as its words."""
    words = F.replace(code, F.lit("_"), F.lit(" "))
    return F.coalesce(mapped(code, texts), F.initcap(words) if title else words)


def ratio(x: Column, y: Column) -> Column:
    """Null where there is nothing to divide by."""
    return F.try_divide(x.cast("double"), y)


def null_strict_sum(x: str) -> Column:
    """The sum, null if any value is null or there is none."""
    return F.when((F.count(x) == F.count("*")) & (F.count("*") > 0), F.sum(x))


def deltas(rows: DataFrame, run: str, step: str, counts: list[str]) -> DataFrame:
    """Growth of each count against the step before, never below 0."""
    w = Window.partitionBy(run).orderBy(step)
    return rows.withColumns({f"new_{c}": F.greatest(F.lit(0), F.col(c) - F.coalesce(F.lag(c).over(w), F.lit(0))) for c in counts})


# Per action the counts whose growth is progress, and how that growth is called.
GROWTH = {
    "web_search": (("acquisition_queue", "new_acquisition_work"),), "acquire_page": (("acquired_pages", "page_acquired"),),
    "analyze_page": (("job_detail_pages", "job_detail_found"), ("pending_followups", "followup_required"), ("rejected_pages", "page_rejected")),
    "job_extraction": (("prepared_jobs", "jobs_prepared"), ("pending_followups", "pending_followup_created")), "explore_followups": (("acquisition_queue", "new_sources_discovered"),),
    "job_understanding": (("understanding_records", "understanding_created"),), "match_analysis": (("match_assessments", "assessment_created"),),
}


def outcomes(steps: DataFrame, run: str, step: str) -> DataFrame:
    """What each step came to: growth of every count, ``signals`` and ``status``.

    ``steps``: run, step, action, last_search, open_queries, errors and the counts that GROWTH names, as they stood after
    the step. A search counts only if it found something itself; new errors beside progress make it partial.
    """
    counts = ["errors", *dict.fromkeys(c for pairs in GROWTH.values() for c, _ in pairs)]
    told, a = deltas(steps, run, step, counts), F.col("action")
    new = lambda c: F.col(f"new_{c}") > 0
    planned, found = (a == "build_search_plan") & (F.col("open_queries") > 0), F.coalesce(F.col("last_search") == "progress", F.lit(False))
    grown, named = planned, [((a == "build_search_plan") & ~planned, F.lit("plan_empty")), (planned, F.lit("plan_created"))]
    named += [((a == "build_search_plan") & ~planned & (F.col("last_search") == "stopped_no_progress"), F.lit("stopped_no_progress")), ((a == "web_search") & F.col("last_search").isNotNull(), F.col("last_search"))]
    for action, pairs in GROWTH.items():
        for count, signal in pairs:
            grown = grown | ((a == action) & new(count) & (found if action == "web_search" else F.lit(True)))
            named.append(((a == action) & new(count), F.lit(signal)))
    fetched = (a == "acquire_page") & new("errors")
    named += [(fetched & new("acquired_pages"), F.lit("partial_acquisition")), (fetched & ~new("acquired_pages"), F.lit("all_failed")), (a == "stop", F.lit("terminal"))]
    status = F.when(a == "stop", "stopped").when(new("errors") & grown, "partial").when(new("errors"), "error").when(grown, "progress").otherwise("no_progress")
    return told.withColumn("signals", F.array_compact(F.array(*(F.when(c, t) for c, t in named)))).withColumn("status", status)


def resolutions(rows: DataFrame, by: str, status: str = "status") -> DataFrame:
    """How follow-ups were settled: a map of status to count per group; rows without a status do not count."""
    kinds = rows.where(F.coalesce(status, F.lit("")) != "").groupBy(by, status).agg(F.count("*").alias("n"))
    return kinds.groupBy(by).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(status, "n")))).alias("resolutions"))


def score_actions(rows: DataFrame) -> DataFrame:
    """``rows`` (one per state and action) with ``components`` and ``total``.

    Columns read: action, executable, fill, deficit, mean_priority, frontier_executable, frontier_high, matches,
    refill_left, yield_rate, last_action, last_status.
    """
    a, d, c = F.col("action"), F.col("deficit").cast("double"), lambda n: F.col(n).cast("double")
    follow, front = a == "explore_followups", c("frontier_executable")
    deficit = (
        F.when(a == "match_analysis", F.when((d > 0) & (d <= 2), 12.0).when(d > 2, 3.0).otherwise(0.0)).when(a.isin("job_understanding", "job_extraction", "analyze_page"), F.least(d, F.lit(8.0)) * 0.75)
        .when(follow, F.least(d, F.lit(8.0)) * 0.55).when(a == "web_search", F.least(d, F.lit(20.0)) * 0.65).when(a == "build_search_plan", F.least(d, F.lit(10.0)) * 0.75).otherwise(0.0)
    )
    cost = F.lit(0.0)
    for name, (model, network) in COSTS.items():
        cost = F.when(a == name, model * 1.5 + network).otherwise(cost)
    parts = {
        "backlog": F.least(c("executable"), F.lit(10.0)),
        "batch_fill": F.least(F.greatest(c("fill"), F.lit(0.0)), F.lit(1.0)) * 2.0,
        "result_deficit": deficit,
        "frontier_priority": F.when(follow & (front > 0), F.coalesce(c("mean_priority"), F.lit(0.0)) / 10.0).otherwise(0.0),
        "frontier_pressure": F.when(follow, F.least(front, F.lit(6.0)) * 0.75 + c("frontier_high") * 0.5).otherwise(0.0),
        "expansion_value": F.when(follow & (front > 0), 1.5).otherwise(0.0),
        "execution_cost": -cost,
        "recent_outcome": F.when(a.isin("explore_followups", "job_extraction", "analyze_page"), F.least(F.coalesce(c("yield_rate"), F.lit(0.0)), F.lit(2.0))).otherwise(0.0),
        "cold_start_frontier": F.when((F.col("matches") == 0) & a.isin("job_extraction", "job_understanding"), 4.0).otherwise(0.0),
        "refill_budget_pressure": F.when((F.col("refill_left") <= 0) & a.isin("job_understanding", "match_analysis"), 4.0).otherwise(0.0),
        "repeat_penalty": F.when((a == F.col("last_action")) & F.col("last_status").isin("error", "no_progress"), -8.0).otherwise(0.0),
    }
    stop = a == "stop"
    parts = {k: F.when(stop & F.lit(k != "repeat_penalty"), 0.0).otherwise(v) for k, v in parts.items()}
    listed = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v)))
    return rows.withColumn("components", listed).withColumn("total", F.aggregate(F.map_values("components"), F.lit(0.0), lambda s, x: s + x))


def choose(scored: DataFrame, state: str, tie: str = "tie_rank") -> DataFrame:
    """Of each state's candidates the one with the highest total; on ties the first in ``tie``."""
    return scored.withColumn("_n", F.row_number().over(Window.partitionBy(state).orderBy(F.desc("total"), tie))).where("_n = 1").drop("_n")


def number_text(x: Column) -> Column:
    """A number in at most six significant digits, without zeros at its end."""
    size = F.abs(x)
    short = F.when(size < 1, F.round(x, 6)).when(size < 10, F.round(x, 5)).when(size < 100, F.round(x, 4)).when(size < 1000, F.round(x, 3)).otherwise(F.round(x, 2))
    return F.regexp_replace(short.cast("string"), "\\.0$", "")


def rationale(scored: DataFrame, state: str, tie: str = "tie_rank") -> DataFrame:
    """Per state the chosen ``action`` and ``rationale``, why it was chosen.

    ``scored`` holds the candidates, at most one row per state and action: action, total, components, last_action,
    last_status. The text names the components that count, a change of action, and the other candidates with their totals.
    """
    others = F.array_sort(F.collect_list(F.struct("action", "total")))
    told = choose(scored, state, tie).join(scored.groupBy(state).agg(others.alias("_all")), state)
    a = F.col("action")
    parts = F.transform(F.filter(F.map_entries("components"), lambda e: e["value"] != 0), lambda e: F.concat(e["key"], F.lit("="), number_text(e["value"])))
    rest = F.filter("_all", lambda o: o["action"] != a)
    beside = lambda name: F.exists("_all", lambda o: o["action"] == name)
    piece = lambda when, text: F.when(when, text).otherwise("")
    text = F.concat(
        F.lit("Deterministic scheduler selected "), a, F.lit(": dynamic score "), number_text(F.col("total")), F.lit(" ("), F.when(F.size(parts) > 0, F.array_join(parts, ", ")).otherwise("no positive components"), F.lit(")"),
        piece(F.col("last_action") != a, F.concat(F.lit("; switched away from previous "), "last_action", F.lit(" "), "last_status")),
        piece((a == "job_extraction") & beside("explore_followups"), F.lit("; downstream extraction work has the stronger current score")),
        piece((a == "analyze_page") & beside("job_extraction"), F.lit("; holding partial downstream batch(es) while upstream work is available")),
        piece(F.size(rest) > 0, F.concat(F.lit("; alternatives: "), F.array_join(F.transform(rest, lambda o: F.concat(o["action"], F.lit("="), number_text(o["total"]))), ", "))), F.lit("."),
    )
    return told.withColumn("rationale", text).drop("_all")


def fallback_features(states: DataFrame, target: int, most: int) -> DataFrame:
    """Goal features where only a state's ``matches`` are known: nothing useful is known of, frontier and results are empty."""
    left = lambda n: F.greatest(F.lit(0), F.lit(n) - F.col("matches"))
    return states.withColumns({"total_match_assessments": F.col("matches"), "useful_match_count": F.lit(0), "result_deficit": left(target), "remaining_result_capacity": left(most), "frontier_executable": F.lit(0), "mean_priority": F.lit(None).cast("double")})
