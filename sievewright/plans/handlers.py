"""The stages of a run as transactions over its tables.

A handler takes its action's batch, works on it with the operators, and returns the tables that change, each whole:
results, markers of what was worked on, errors and follow-ups together. :func:`sievewright.plans.loop.drive` writes them
in one step, so a step that fails leaves all tables as they were and its batch is still to do.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .. import schemas
from ..functions.education import level_rank
from ..functions.markup import structure
from ..functions.urls import http_only, normalize_url
from ..operators import admission, eligibility, features, followups, pages, records, stages
from ..session import ready, stored
from .loop import Run, counted
from .numbering import numbered
from .search_plan import search_queries

_FACTS = "company_name string, company_type string, title string, description string, requirements string, recruitment_type string, graduation_start string, graduation_end string, graduation_requirement string, deadline string, source_name string, apply_url string, source_url string, is_official boolean, locations array<string>, graduation_years array<string>, education_levels array<string>"
_FOLLOWUP = "ord long, url string, final_url string, title string, source_name string, company_name string, company_type string, is_official boolean, pending_kind string, reasons array<string>, suggested_next_action string, priority int, links array<struct<url:string,text:string,kind:string>>, stage string"
_LIST = "array<string>"
_UNDERSTANDING = re.sub(r"(^|, )(\w+) ", r"\1\2:", schemas.UNDERSTANDING)
#: The tables of a run; what is worked on has an order (``ord``), what is done is a marker.
TABLES = {
    "search_plan": "idx int, query string", "executed_queries": "query string", "query_history": "query string",
    "candidate_sources": schemas.SOURCE, "acquisition_queue": schemas.SOURCE, "selected_sources": "url string",
    "acquired_pages": "ord long, url string, final_url string, title string, html string, text string, links array<struct<href:string,text:string>>, status_code int, fetch_error string, source_name string, company_name string, company_type string, location string, is_official boolean",
    "analyzed_pages": "url string", "rejected_pages": "url string, reason string",
    "job_detail_pages": "ord long, url string, final_url string, source_name string, source_company_name string, company_type string, source_location string, is_official boolean, title string, visible_text string, important_links array<struct<url:string,text:string,kind:string>>",
    "extracted_pages": "url string", "pending_followups": _FOLLOWUP, "explored_links": "url_key string", "processed_followups": "url string", "followup_resolutions": "url string, status string, discovered long, skipped long, invalid long",
    "prepared_jobs": f"ord long, deduplication_key string, {_FACTS}, gate_flags {_LIST}", "understood_jobs": "deduplication_key string",
    "understanding_records": f"ord long, deduplication_key string, understanding struct<{_UNDERSTANDING}>",
    "matched_jobs": "deduplication_key string",
    "match_assessments": f"ord long, deduplication_key string, match_score int, recommendation string, role_fit string, must_have_fit string, final_confidence string, match_reasons {_LIST}, missing_requirements {_LIST}, risk_flags {_LIST}, analysis_source string, score_components map<string,int>",
    "errors": "ord long, stage string, url string, deduplication_key string, reason string",
}
#: Per action its backlog, the markers of what is done, and their key; a queue is itself what is left.
BACKLOGS = {
    "acquire_page": ("acquisition_queue", None, "url"), "analyze_page": ("acquired_pages", "analyzed_pages", "url"), "job_extraction": ("job_detail_pages", "extracted_pages", "url"),
    "job_understanding": ("prepared_jobs", "understood_jobs", "deduplication_key"), "match_analysis": ("understanding_records", "matched_jobs", "deduplication_key"),
}

Ask = Callable[[DataFrame], DataFrame]


@dataclass
class Handlers:
    """What a run reaches outside its tables, and the handler of each action.

    ``search``: queries (idx, query) to answers (ord, title, url, content, score); ``fetch``: sources (url) to responses (url, final_url, html,
    status_code, fetch_error); ``ask``: per stage, requests (key, ``prompt``) to answers (key, ``answer``, ``error``).
    ``profile``: one row as :func:`sievewright.sources.readers.profile` gives it. Answers are stored before they are used, so a
    lost executor asks nothing twice.
    """

    profile: DataFrame
    as_of: str
    search: Ask
    fetch: Ask
    ask: dict[str, Ask]
    instructions: dict[str, str] = field(default_factory=dict)

    def bound(self) -> dict[str, Callable[[Run], dict[str, DataFrame]]]:
        """Action to handler, as ``drive`` wants them."""
        return {a: getattr(self, a) for a in ("build_search_plan", "web_search", "acquire_page", "analyze_page", "job_extraction", "explore_followups", "job_understanding", "match_analysis")}

    def _asked(self, stage: str, requests: DataFrame) -> DataFrame:
        return stored(self.ask[stage](requests), f"answers-{stage}")

    def _said(self, stage: str) -> str:
        return self.instructions.get(stage, "")

    # Search.

    def build_search_plan(self, run: Run) -> dict[str, DataFrame]:
        """The next round's queries; without any there is nothing left to search for."""
        p = self.profile.select(F.lit(1).alias("profile"), F.lit(int(run.facts.get("search_rounds", 0))).alias("round"), F.col("graduation_date").alias("graduation"), F.col("target_roles").alias("roles"), F.col("preferred_locations").alias("places"), F.col("preferred_company_types").alias("kinds"))
        plan = stored(search_queries(p, run.tables["query_history"].select(F.lit(1).alias("profile"), "query")).select("idx", "query"), "plan")
        if plan.isEmpty():
            run.facts |= {"last_search": "stopped_no_progress", "open_queries": 0}
            return {}
        run.facts |= {"has_plan": True, "last_search": "none", "open_queries": plan.count()}
        return {"search_plan": plan, "executed_queries": run.tables["executed_queries"].where("false")}

    def web_search(self, run: Run) -> dict[str, DataFrame]:
        """Queries not yet asked; of the answers the first ``max_sources_per_round`` new addresses join the queue."""
        t = run.tables
        queries = t["search_plan"].join(t["executed_queries"], "query", "left_anti")
        asked = {n: appended(t[n], queries.select("query")).distinct() for n in ("executed_queries", "query_history")}
        run.facts["open_queries"] = 0
        try:
            found = stored(self.search(queries), "search-answers")
        except Exception as e:
            run.facts["last_search"] = "error"
            return asked | {"errors": appended(t["errors"], error_row(run, "web_search", f"{type(e).__name__}: {e}"))}
        rows = admission.searched(found.withColumn("url_key", normalize_url("url")), None)
        told = sources(placed(run, rows.join(found.select("ord", normalize_url("url").alias("_key")), "ord").withColumn("url", F.coalesce("_key", "url")), "ord"))
        judged = stored(admission.admit(told.withColumn("url_key", http_only(F.col("url"))), t["acquisition_queue"].select(F.col("url").alias("url_key")), handled(t), limit=run.limits.get("max_sources_per_round", 10)), "admitted")
        new = judged.where("outcome = 'admitted'")
        run.facts["search_rounds"] = run.facts.get("search_rounds", 0) + 1
        run.facts["last_search"] = "no_progress" if new.isEmpty() else "progress"
        return asked | {"candidate_sources": merged(t["candidate_sources"], told, "url"), "acquisition_queue": appended(t["acquisition_queue"], sources(new)), "selected_sources": appended(t["selected_sources"], new.select("url")).distinct()}

    # Pages.

    def acquire_page(self, run: Run) -> dict[str, DataFrame]:
        """The batch leaves the queue; a source that cannot be fetched is an error."""
        t = run.tables
        ready(run.spark)
        batch, rest = taken(run, "acquire_page")
        got = stored(self.fetch(batch.select("url")), "responses")
        page = batch.join(got, "url").withColumn("_s", structure(F.when(F.col("fetch_error").isNull(), F.col("html")), F.coalesce("final_url", "url")))
        good = page.where("fetch_error is null").withColumns({"title": F.coalesce("_s.title", "title"), "text": F.col("_s.text"), "links": F.col("_s.links")})
        failed = batch.select("url", "ord").join(got.select("url", "fetch_error"), "url", "left").where("fetch_error is not null").select("ord", F.lit("acquire_page").alias("stage"), "url", F.col("fetch_error").alias("reason"))
        unanswered = batch.join(got, "url", "left_anti").select("ord", F.lit("acquire_page").alias("stage"), "url", F.lit("no response").alias("reason"))
        return {"acquisition_queue": rest, "acquired_pages": appended(t["acquired_pages"], good), "errors": appended(t["errors"], failed.unionByName(unanswered))}

    def analyze_page(self, run: Run) -> dict[str, DataFrame]:
        """Clean pages, judge them, ask what they are: postings go on, others become follow-ups, bad ones are rejected."""
        t = run.tables
        batch, _ = taken(run, "analyze_page")
        cleaned = pages.cleaned_text(pages.clean_lines(batch, "url"), "url").select("url", F.col("text").alias("visible_text"))
        told = stored(batch.join(cleaned, "url", "left").withColumn("visible_text", F.coalesce("visible_text", F.lit(""))).withColumn("failure", pages.quality_failure(F.col("status_code"), F.col("fetch_error"), F.col("visible_text"))), "cleaned")
        links = _links(told.where("failure is null"))
        source = F.create_map(*(x for c in ("final_url", "company_name", "company_type", "location") for x in (F.lit(c), F.col(c))), F.lit("is_official"), F.col("is_official").cast("string"))
        none = F.array().cast("array<struct<url:string,text:string,kind:string>>")
        inputs = told.where("failure is null").join(links, "url", "left").withColumns({"metadata": source, "important_links": F.coalesce("important_links", none)})
        inputs = pages.ai_input(inputs.select("ord", "url", "source_name", "title", "metadata", "visible_text", "important_links"))
        answers = self._asked("analyze_page", stages.classification_requests(inputs, self._said("analyze_page"), "url"))
        good, bad = stages.classified(inputs, answers, "url")
        bad = bad.select("url", F.concat(F.lit("semantic_classification_failed: "), "reason").alias("error"))
        later = followups.classified_followups(good).unionByName(followups.failed_followups(inputs.join(bad, "url")))
        later = later.join(inputs.select("url", "ord"), "url")
        rejected = told.where("failure is not null").select("url", F.col("failure").alias("reason"))
        errors = bad.join(inputs.select("url", "ord"), "url").select("ord", F.lit("analyze_page").alias("stage"), "url", F.col("error").alias("reason"))
        return {
            "job_detail_pages": merged(t["job_detail_pages"], good.where("page_type = 'job_detail'"), "url"), "analyzed_pages": appended(t["analyzed_pages"], batch.select("url")).distinct(),
            "pending_followups": appended(t["pending_followups"], later), "rejected_pages": appended(t["rejected_pages"], rejected), "errors": appended(t["errors"], errors),
        }

    # Jobs.

    def job_extraction(self, run: Run) -> dict[str, DataFrame]:
        """Ask each page for its jobs; pages with too little become follow-ups, their jobs and those that the gate rejects go no further."""
        t = run.tables
        batch, _ = taken(run, "job_extraction")
        answers = self._asked("job_extraction", stages.page_requests(batch.withColumn("page_id", F.col("url")), self._said("job_extraction")))
        raw, failed = stages.extracted_singly(batch.withColumn("page_id", F.col("url")), answers)
        lists = {c: F.coalesce(c, F.array().cast(_LIST)) for c in ("locations", "graduation_years", "education_levels")}  # what is not told is empty, not unknown to the gate
        raw = stored(complete(raw, f"page_url string, ord long, place int, {_FACTS}").withColumns(lists), "raw-jobs")
        asked = batch.select(F.col("url").alias("page"), (F.size("important_links") > 0).alias("has_links"))
        triage = followups.extraction_triage(asked, raw.select(F.col("page_url").alias("page"), "title", "description", "requirements", (F.size(F.coalesce("locations", F.array().cast(_LIST))) > 0).alias("has_location"), "apply_url"), "page")
        triage = stored(triage.where("rule is not null").select(F.col("page").alias("url"), "rule", "pending_kind", F.col("priority").alias("_priority")), "triage")
        action = F.when(F.col("rule") == "no_records", "manual_review").otherwise("fetch_detail_links")
        later = followups.followup_rows(batch.join(triage, "url"), F.col("pending_kind"), action, F.col("_priority"), F.array("rule"), "post_extraction").join(batch.select("url", "ord"), "url")
        kept = raw.join(triage.select(F.col("url").alias("page_url")), "page_url", "left_anti")
        judged = kept.withColumn("reasons", records.validation_reasons(F.col("title"), F.col("source_url"), F.col("deadline")))
        invalid = judged.where(F.size("reasons") > 0).select("ord", F.lit("job_extraction").alias("stage"), F.col("page_url").alias("url"), F.array_join("reasons", "; ").alias("reason"))
        normal = numbered(records.normalize_records(judged.where(F.size("reasons") == 0).drop("reasons")), "ord", "place").withColumn("ord", at_step(run, F.col("row_no")))
        filled = records.populated(list(records.FACTS), ("locations", "graduation_years", "education_levels"))
        unique = records.best_of_equals(normal, "deduplication_key", "ord", F.coalesce("is_official", F.lit(False)), filled).where("best")
        gated = eligibility.basic_gate(unique.crossJoin(F.broadcast(self._gate())), F.lit(self.as_of).cast("date"))
        passed = gated.where("decision = 'pass'").withColumn("gate_flags", F.col("risk_flags"))
        errors = failed.join(batch.select("url", "ord"), "url").select("ord", "stage", "url", "reason").unionByName(invalid)
        return {
            "prepared_jobs": merged(t["prepared_jobs"], passed, "deduplication_key"), "extracted_pages": appended(t["extracted_pages"], batch.select("url")).distinct(),
            "pending_followups": appended(t["pending_followups"], later), "errors": appended(t["errors"], errors),
        }

    def _gate(self) -> DataFrame:
        return self.profile.select(F.col("graduation_date").alias("p_graduation"), F.col("education").alias("p_education"), F.col("excluded_locations").alias("p_excluded"), level_rank(F.col("education")).alias("p_education_rank"))

    def job_understanding(self, run: Run) -> dict[str, DataFrame]:
        t = run.tables
        batch, _ = taken(run, "job_understanding")
        batch = batch.withColumn("hard_reject", F.lit(False))
        answers = self._asked("job_understanding", stages.understanding_requests(batch, self._said("job_understanding")))
        good, bad = stages.understood(batch, answers)
        errors = bad.join(batch.select("deduplication_key", "ord"), "deduplication_key").select("ord", "stage", "deduplication_key", "reason")
        return {"understanding_records": merged(t["understanding_records"], good.join(batch.select("deduplication_key", "ord"), "deduplication_key"), "deduplication_key"), "understood_jobs": appended(t["understood_jobs"], batch.select("deduplication_key")).distinct(), "errors": appended(t["errors"], errors)}

    def match_analysis(self, run: Run) -> dict[str, DataFrame]:
        t = run.tables
        batch, _ = taken(run, "match_analysis")
        none, wanted = F.array().cast(_LIST), F.broadcast(self.profile.select(F.col("preferred_locations").alias("preferred")))
        jobs = t["prepared_jobs"].crossJoin(wanted).withColumns({"hard_reject": F.lit(False), "gate_reasons": none, "gate_missing": none, "is_official": F.coalesce("is_official", F.lit(False)), "locations": F.coalesce("locations", none)})
        found = batch.select("deduplication_key", "understanding").join(jobs, "deduplication_key")
        profile = self.profile.agg(F.first(F.struct(*self.profile.columns)).alias("_profile"))
        answers = self._asked("match_analysis", stages.match_requests(found.crossJoin(F.broadcast(profile)), F.col("_profile"), self._said("match_analysis")))
        good, bad = stages.matched(batch.select("deduplication_key", "understanding"), jobs, answers)
        orders = batch.select("deduplication_key", F.col("ord").alias("_ord"))
        errors = bad.join(orders, "deduplication_key").select(F.col("_ord").alias("ord"), "stage", "deduplication_key", "reason")
        scored = good.join(orders, "deduplication_key").withColumn("ord", F.col("_ord"))
        return {"match_assessments": merged(t["match_assessments"], scored, "deduplication_key"), "matched_jobs": appended(t["matched_jobs"], batch.select("deduplication_key")).distinct(), "errors": appended(t["errors"], errors)}

    # Follow-ups.

    def explore_followups(self, run: Run) -> dict[str, DataFrame]:
        """New addresses among the links of the first follow-ups that have some join the queue; the follow-ups are settled."""
        t = run.tables
        fus, able = open_followups(t)
        batch = stored(able.orderBy("ord", "url", "stage").limit(run.limits["batch"]), "followup-batch")
        named = fus.join(batch, ["ord", "url", "stage"], "left_semi").withColumn("fu", F.struct("ord", "url", "stage"))
        found, report = followups.explore(named, excluded(t), t["explored_links"])
        found = stored(found, "explored")
        known = followups.candidate_sources(found, named)
        told = numbered(known.withColumn("_fu", F.col("fu.ord")), "_fu", "ord", "url").withColumn("ord", at_step(run, F.col("row_no")))
        told = stored(sources(told), "found-sources")
        judged = admission.admit(told.withColumn("url_key", F.col("url")), t["acquisition_queue"].select(F.col("url").alias("url_key")), handled(t))
        return {
            "candidate_sources": merged(t["candidate_sources"], told, "url"), "acquisition_queue": appended(t["acquisition_queue"], sources(judged.where("outcome = 'admitted'"))), "selected_sources": appended(t["selected_sources"], told.select("url")).distinct(),
            "pending_followups": t["pending_followups"].join(batch, ["ord", "url", "stage"], "left_anti"), "explored_links": appended(t["explored_links"], found.select(F.col("url").alias("url_key"))).distinct(),
            "processed_followups": appended(t["processed_followups"], batch.select("url")).distinct(), "followup_resolutions": appended(t["followup_resolutions"], report.withColumn("url", F.col("fu.url"))),
        }


def started(spark: SparkSession, path: str, queue: DataFrame | None = None, **limits) -> Run:
    """A run with empty tables, or with sources to begin with (normalised addresses, in order)."""
    tables = {n: spark.createDataFrame([], ddl) for n, ddl in TABLES.items()}
    if queue is not None:
        told = sources(queue.withColumn("url", normalize_url("url")).where("url is not null"))
        first = told.withColumn("_n", F.row_number().over(Window.partitionBy("url").orderBy("ord"))).where("_n = 1")
        tables |= {"acquisition_queue": complete(first, TABLES["acquisition_queue"]), "candidate_sources": complete(first, TABLES["candidate_sources"])}
    run = Run(spark, path, tables)
    run.limits |= limits
    return run


def complete(rows: DataFrame, ddl: str) -> DataFrame:
    """``rows`` in the columns and types of ``ddl``; columns they lack are null, others go."""
    shape = rows.sparkSession.createDataFrame([], ddl).schema
    return rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in shape))


def appended(table: DataFrame, rows: DataFrame) -> DataFrame:
    return table.unionByName(rows.select(*((F.col(f.name) if f.name in rows.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in table.schema)))


def merged(table: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """Rows of both by ``key``: the last one's values at the place of the first."""
    new = appended(table.where("false"), rows)
    both = table.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    kept = records.last_wins(both.withColumns({"_at": F.struct("_new", "ord"), "_ord": F.col("ord")}), [key], "_at")
    return kept.withColumn("ord", F.col("position.ord")).select(*table.columns)


def sources(rows: DataFrame) -> DataFrame:
    return complete(rows, schemas.SOURCE)


def at_step(run: Run, place):
    """Where rows of a step stand: behind those of all earlier ones."""
    return F.lit((run.step + 1) << 40) + place.cast("long")


def placed(run: Run, rows: DataFrame, order: str) -> DataFrame:
    return rows.withColumn("ord", at_step(run, F.col(order)))


def error_row(run: Run, stage: str, reason: str) -> DataFrame:
    return run.spark.createDataFrame([((run.step + 1) << 40, stage, reason[:200])], "ord long, stage string, reason string")


def handled(t: dict[str, DataFrame]) -> DataFrame:
    """Addresses that need no fetching: acquired, rejected, failed."""
    return reduce(lambda a, b: a.unionByName(b), (t[n].select(F.col("url").alias("url_key")).where("url is not null") for n in ("acquired_pages", "rejected_pages", "errors")))


def excluded(t: dict[str, DataFrame]) -> DataFrame:
    return handled(t).unionByName(t["acquisition_queue"].select(F.col("url").alias("url_key")))


def taken(run: Run, action: str) -> tuple[DataFrame, DataFrame]:
    """(the action's batch, stored, and what is left of its table)."""
    name, markers, key = BACKLOGS[action]
    todo = run.tables[name] if markers is None else admission.backlog(run.tables[name], run.tables[markers], key)
    batch = stored(admission.take_batch(todo, run.limits["batch"], "ord"), f"batch-{action}")
    return batch, run.tables[name].join(batch.select(key), key, "left_anti").select(*run.tables[name].columns)


def open_followups(t: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(follow-ups with their links as addresses, names of those that lead to a new one)."""
    name = ["ord", "url", "stage"]
    each = t["pending_followups"].where("pending_kind = 'navigation_required'").select(*name, F.posexplode("links").alias("at", "l")).select(*name, "at", "l.text", normalize_url("l.url").alias("_key"))
    each = each.withColumn("url_key", http_only(F.col("_key")))
    listed = each.groupBy(*name).agg(F.array_sort(F.collect_list(F.struct(F.col("at").cast("long").alias("ord"), "url_key", "text"))).alias("links"))
    fus = t["pending_followups"].drop("links").join(listed, name)
    barred = excluded(t).unionByName(t["explored_links"]).distinct()
    return fus, each.where("url_key is not null").join(barred, "url_key", "left_anti").select(*name).distinct()


def _links(told: DataFrame) -> DataFrame:
    """``url`` and ``important_links`` (at most ten, in order)."""
    rows = pages.important_links(told.select("url", F.transform("links", lambda x: F.struct(x["href"].alias("href"), x["text"].alias("text"))).alias("links"), F.col("visible_text").alias("text")).withColumnRenamed("url", "page"), "page")
    listed = F.transform(F.array_sort(F.collect_list(F.struct("place", F.struct("url", F.col("label").alias("text"), "kind").alias("x")))), lambda x: x["x"])
    return rows.groupBy("page").agg(listed.alias("important_links")).withColumnRenamed("page", "url")


def pending(run: Run) -> dict[str, int]:
    """What each action has left to do."""
    return run_features(run)["executable"]


def run_features(run: Run) -> dict:
    """What scheduling looks at, from the run's own tables in one job: executable work per action, the frontier, yields, refill.

    The yield of an action that was the last one is its own step's, as the step's growth tells; that of others is the
    whole run's. Follow-ups count as executable only if one of their links leads to a new address.
    """
    t, rows = run.tables, []
    counts = run.counts if set(run.counts) == set(t) else counted(run)
    told = dict.fromkeys((*BACKLOGS, "executable", "high_priority_executable"), 0) | counts | {"mean_priority": None}
    told["acquire_page"] = counts["acquisition_queue"]
    for action, (name, markers, key) in BACKLOGS.items():
        if markers is not None and counts[name]:
            rows.append(admission.backlog(t[name], t[markers], key).agg(F.lit(action).alias("name"), F.count("*").cast("double").alias("value")))
    if counts["pending_followups"]:
        able = open_followups(t)[1].withColumn("_able", F.lit(True))
        front = features.frontier(t["pending_followups"].join(able, ["ord", "url", "stage"], "left"), "priority", F.coalesce("_able", F.lit(False)), F.size("links"))
        rows.append(front.select(F.inline(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in ("executable", "mean_priority", "high_priority_executable"))))))
    if rows:
        told |= {r["name"]: r["value"] for r in reduce(lambda a, b: a.unionByName(b), rows).collect()}
    executable = {a: int(told[a]) for a in BACKLOGS} | {"explore_followups": int(told["executable"])}
    last = run.last or {}
    yields = {}
    for action, (made, used) in YIELDS.items():
        source = last.get("growth", {}) if last.get("action") == action else told
        yields[action] = source.get(made, 0) / source[used] if source.get(used) else None
    return {
        "executable": executable, "mean_priority": told["mean_priority"], "frontier_executable": executable["explore_followups"], "frontier_high": int(told["high_priority_executable"] or 0),
        "yields": yields, "refill_left": run.limits.get("refill", 2),
    }


#: What an action yields, by the table that grows and the markers of what it worked on.
YIELDS = {"explore_followups": ("selected_sources", "explored_links"), "job_extraction": ("prepared_jobs", "extracted_pages"), "analyze_page": ("job_detail_pages", "analyzed_pages")}
