"""Queries over model stages, their batches and errors, steps' outcomes, and what a person is shown."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import features, followups, pages, records, stages
from ..session import table
from .registry import registry

QUERIES, SQL, query = registry()


def _picked(at, *values):
    """One of ``values`` by a whole number."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (at % len(values) + 1).cast("int"))


@query("""
SELECT page_id, CASE page_id % 5 WHEN 1 THEN 'job_detail' WHEN 2 THEN 'job_listing' END AS page_type, CASE page_id % 5 WHEN 1 THEN 'extract_jobs' WHEN 2 THEN 'fetch_detail_links' END AS next_action,
 CASE page_id % 5 WHEN 2 THEN 80 WHEN 1 THEN 50 END AS priority, CASE page_id % 5 WHEN 0 THEN 'no recorded answer' WHEN 3 THEN 'answer does not fit its schema' WHEN 4 THEN 'provider down' END AS error FROM pages
""")
def page_classification(spark, d):
    """Recorded answers: some name the wrong action, some an unknown type, some failed, some are missing."""
    k = F.col("page_id")
    rows = table(spark, d, "pages").select("page_id", "url", F.lit("t").alias("title"))
    answer = F.when(k % 5 == 4, F.lit(None)).otherwise(F.format_string('{"page_type":"%s","suggested_next_action":"manual_review","reasons":["seen"]}', _picked(k, "job_listing", "job_detail", "job_listing", "poem", "poem")))
    answers = rows.where(k % 5 > 0).select("page_id", answer.alias("answer"), F.when(k % 5 == 4, "provider down").alias("error"))
    good, bad = stages.classified(rows, answers)
    return good.select("page_id", "page_type", "next_action", "priority", F.lit(None).cast("string").alias("error")).unionByName(bad.select("page_id", F.col("reason").alias("error")), allowMissingColumns=True)


@query("SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 3 AS batch FROM pages")
def page_batches(spark, d):
    return stages.batched(table(spark, d, "pages").select("page_id"), "page_id", 3)


@query("""
WITH b AS (SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 3 AS batch FROM pages), f AS (SELECT *, batch % 5 AS k, min(page_id) OVER (PARTITION BY batch) AS low FROM b)
SELECT page_id, CASE WHEN k = 0 THEN 'Role ' || page_id END AS title, CASE WHEN k = 0 THEN 'Company of ' || page_id END AS company_name,
 CASE k WHEN 1 THEN 'AI extraction returned duplicate page_id values.' WHEN 2 THEN 'AI extraction page_id values do not match the input pages.' WHEN 3 THEN 'answer does not fit its schema' WHEN 4 THEN 'no recorded answer' END AS error FROM f
""")
def page_extraction(spark, d):
    """Batches of three pages: an answer repeats a page, leaves one out, is no JSON or is missing; its pages fail, all others do not."""
    none, k = F.lit(None).cast("string"), F.col("batch") % 5
    rows = stages.batched(table(spark, d, "pages").select("page_id"), "page_id", 3).withColumn("page_id", F.col("page_id").cast("string"))
    link = F.struct(F.lit("").alias("url"), F.lit("").alias("text"), F.lit("other").alias("kind"))
    shown = rows.select("batch", "page_id", F.concat(F.lit("https://j.example/"), "page_id").alias("url"), F.lit("s").alias("source_name"), none.alias("source_company_name"), none.alias("company_type"), none.alias("source_location"), F.lit(False).alias("is_official"), F.lit("t").alias("title"), F.lit("x").alias("visible_text"), F.array(link).alias("important_links"))
    one = F.format_string('{"page_id":"%s","page_context":{"company_name":"Company of %s"},"jobs":[{"title":"Role %s"}]}', "page_id", "page_id", "page_id")
    listed = rows.groupBy("batch").agg(F.array_sort(F.collect_list(one)).alias("l"))
    held = F.when(k == 1, F.concat("l", F.slice("l", 1, 1))).when(k == 2, F.slice("l", F.lit(1), F.size("l") - 1)).otherwise(F.col("l"))
    answers = listed.where(k < 4).select("batch", F.when(k == 3, "nothing to say").otherwise(F.concat(F.lit("["), F.array_join(held, ","), F.lit("]"))).alias("answer"), none.alias("error"))
    raw, bad = stages.extracted(shown, answers)
    good = raw.select(F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long").alias("page_id"), "title", "company_name", none.alias("error"))
    return good.unionByName(bad.select(F.col("page_id").cast("long").alias("page_id"), F.col("reason").alias("error")), allowMissingColumns=True)


def _gated(spark, d):
    """Orders as jobs behind the gate; every seventh customer's are hard rejects."""
    none = F.array().cast("array<string>")
    k = F.col("o_custkey")
    return table(spark, d, "orders").select(
        F.col("o_orderkey").alias("ord"), F.col("o_orderkey").cast("string").alias("deduplication_key"), F.lit("c").alias("company_name"), F.lit("t").alias("title"), (k % 7 == 0).alias("hard_reject"),
        F.when(k % 7 == 0, F.array(F.lit("Too late."))).otherwise(none).alias("gate_reasons"), F.when(k % 2 == 0, F.array(F.lit("deadline_unknown"))).otherwise(none).alias("gate_flags"), none.alias("locations"), none.alias("preferred"), F.lit(True).alias("is_official"), k.alias("who"),
    )


@query("""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 7 > 0 AND o_orderkey % 4 = 1 THEN 'Role' END AS canonical_role,
 CASE WHEN o_custkey % 7 = 0 THEN 'Job understanding received a job that did not pass Basic Gate.' WHEN o_orderkey % 4 = 0 THEN 'no recorded answer' WHEN o_orderkey % 4 > 1 THEN 'answer does not fit its schema' END AS error FROM orders
""")
def job_understanding(spark, d):
    """Answers without a role or of no known confidence do not count, nor does one to a job that the gate stopped."""
    jobs, k = _gated(spark, d), F.col("ord") % 4
    answers = jobs.where(k > 0).select("deduplication_key", F.when(k == 1, '{"canonical_role":"Role","confidence":"high"}').when(k == 2, '{"canonical_role":"Role","confidence":"sure"}').otherwise('{"confidence":"high"}').alias("answer"), F.lit(None).cast("string").alias("error"))
    good, bad = stages.understood(jobs, answers)
    return good.select(F.col("deduplication_key").cast("long").alias("id"), "understanding.canonical_role", F.lit(None).cast("string").alias("error")).unionByName(bad.select(F.col("deduplication_key").cast("long").alias("id"), F.col("reason").alias("error")), allowMissingColumns=True)


@query("""
WITH j AS (SELECT o_orderkey AS id, o_custkey % 7 = 0 AS rejected, o_custkey % 11 = 0 AS lost, o_orderkey % 4 AS k, o_custkey % 2 AS f, o_orderkey % 3 AS r FROM orders),
e AS (SELECT *, CASE WHEN lost THEN 'Prepared job was not found.' WHEN rejected THEN NULL WHEN k = 0 THEN 'no recorded answer' WHEN k = 3 THEN 'answer does not fit its schema' END AS error,
 ((CASE r WHEN 0 THEN 100 WHEN 1 THEN 65 ELSE 20 END) * 35 + 60 * 25 + (CASE f WHEN 0 THEN 90 ELSE 100 END) * 20 + 50 * 10) // 90 AS s FROM j)
SELECT id, CAST(CASE WHEN error IS NULL THEN CASE WHEN rejected THEN 0 ELSE s END END AS INTEGER) AS match_score, CASE WHEN error IS NULL THEN CASE WHEN rejected THEN 'skip' WHEN s >= 70 THEN 'apply' WHEN s >= 40 THEN 'consider' ELSE 'low_priority' END END AS recommendation,
 CASE WHEN error IS NULL THEN CASE WHEN rejected THEN 'deterministic_only' ELSE 'semantic_with_program_scoring' END END AS analysis_source, CASE WHEN error IS NULL THEN CASE WHEN rejected THEN 'Too late.' ELSE 'fits' END END AS reasons, error FROM e
""")
def match_stage(spark, d):
    """Understood jobs to final assessments: some jobs are gone, hard rejects need no answer, some answers are missing or wrong."""
    jobs, k = _gated(spark, d), F.col("ord")
    found = jobs.select("deduplication_key", F.struct(F.lit("high").alias("confidence")).alias("understanding"))
    verdict = F.format_string('{"role_fit":"%s","must_have_fit":"partial","match_reasons":["fits"],"risk_flags":[],"confidence":"%s"}', _picked(k % 3, "high", "medium", "low"), F.when(k % 4 == 3, "sure").otherwise("high"))
    answers = jobs.where(k % 4 > 0).select("deduplication_key", verdict.alias("answer"), F.lit(None).cast("string").alias("error"))
    good, bad = stages.matched(found, jobs.where(F.col("who") % 11 > 0), answers)
    key = F.col("deduplication_key").cast("long").alias("id")
    told = good.select(key, F.col("match_score").cast("int").alias("match_score"), "recommendation", "analysis_source", F.array_join("match_reasons", ";").alias("reasons"), F.lit(None).cast("string").alias("error"))
    return told.unionByName(bad.select(key, F.col("reason").alias("error")), allowMissingColumns=True)


@query("""
SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(['Data', source, 'campus', 'graduate', '2026', '2027', '校招', '应届']), lambda k: contains(lower(text || ' ' || source), lower(k)))), ',') AS plan_signals FROM documents
""")
def plan_signals(spark, d):
    every = F.lower(F.concat_ws(" ", "text", "source"))
    return table(spark, d, "documents").select("doc_id", F.array_join(pages.plan_signals(every, F.array(F.lit("Data"), F.lit("")), F.array("source")), ",").alias("plan_signals"))


@query("""
SELECT page_id, 'https://f/' || page_id AS final_url, CASE WHEN page_id % 2 = 0 THEN 'C' END AS source_company_name, NULL::VARCHAR AS source_location, page_id % 3 = 0 AS is_official, html AS visible_text FROM pages
""")
def ai_input(spark, d):
    k = F.col("page_id")
    told = F.create_map(F.lit("final_url"), F.concat(F.lit("https://f/"), k.cast("string")), F.lit("company_name"), F.when(k % 2 == 0, " C ").otherwise("  "), F.lit("is_official"), (k % 3 == 0).cast("string"))
    rows = table(spark, d, "pages").select("page_id", "url", F.lit("s").alias("source_name"), F.lit("t").alias("title"), told.alias("metadata"), F.col("html").alias("visible_text"), F.array().cast("array<string>").alias("important_links"))
    return pages.ai_input(rows).select("page_id", "final_url", "source_company_name", "source_location", "is_official", "visible_text")


@query("""
WITH s AS (SELECT user_id, event_id, event_type, event_id % 4 AS k FROM events)
SELECT user_id, event_id, CASE k WHEN 0 THEN 'stopped' ELSE CASE WHEN event_type = 'error' THEN 'error' WHEN (k = 1 AND event_type = 'view') OR (k = 2 AND event_type IN ('purchase', 'signup')) OR (k = 3 AND event_type = 'click' AND event_id % 3 = 0) THEN 'progress' ELSE 'no_progress' END END AS status,
 CASE k WHEN 0 THEN 'terminal' WHEN 1 THEN CASE event_type WHEN 'view' THEN 'page_acquired' WHEN 'error' THEN 'all_failed' ELSE '' END WHEN 2 THEN CASE event_type WHEN 'purchase' THEN 'jobs_prepared' WHEN 'signup' THEN 'pending_followup_created' ELSE '' END
 ELSE CASE WHEN event_id % 3 = 0 THEN 'progress' ELSE 'error' END || CASE WHEN event_type = 'click' THEN ',new_acquisition_work' ELSE '' END END AS signals FROM s
""")
def step_outcomes(spark, d):
    """Events as steps of a run per user: every event type grows a count of its own."""
    from pyspark.sql.window import Window

    w, k = Window.partitionBy("user_id").orderBy("event_id"), F.col("event_id")
    n = lambda t: F.count_if(F.col("event_type") == t).over(w)
    zero = F.lit(0).cast("long")
    steps = table(spark, d, "events").select(
        "user_id", "event_id", _picked(k, "stop", "acquire_page", "job_extraction", "web_search").alias("action"), F.when(k % 3 == 0, "progress").otherwise("error").alias("last_search"), zero.alias("open_queries"), n("error").alias("errors"), n("click").alias("acquisition_queue"),
        n("view").alias("acquired_pages"), n("purchase").alias("prepared_jobs"), n("signup").alias("pending_followups"), *(zero.alias(c) for c in ("job_detail_pages", "rejected_pages", "understanding_records", "match_assessments")),
    )
    return features.outcomes(steps, "user_id", "event_id").select("user_id", "event_id", "status", F.array_join("signals", ",").alias("signals"))


@query("SELECT user_id, string_agg(event_type || '=' || n, ',' ORDER BY event_type) AS resolutions FROM (SELECT user_id, event_type, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL) GROUP BY user_id")
def followup_resolutions(spark, d):
    rows = table(spark, d, "events").select("user_id", F.when(F.col("event_type") != "error", F.col("event_type")).alias("status"))
    told = F.transform(F.map_entries("resolutions"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return features.resolutions(rows, "user_id").select("user_id", F.array_join(told, ",").alias("resolutions"))


@query("""
WITH s AS (SELECT c_custkey AS state, c_custkey % 8 AS m, c_custkey % 5 * 1.25 AS e FROM customer)
SELECT state, CASE WHEN e > m THEN 'job_extraction' ELSE 'match_analysis' END AS action, 'Deterministic scheduler selected ' || CASE WHEN e > m THEN 'job_extraction: dynamic score ' || CASE WHEN e = 5 THEN '5' WHEN e = 2.5 THEN '2.5' ELSE rtrim(CAST(e AS VARCHAR), '0') END || ' (backlog=' || CASE WHEN e = 5 THEN '5' WHEN e = 2.5 THEN '2.5' ELSE rtrim(CAST(e AS VARCHAR), '0') END || '); alternatives: match_analysis=' || m
 ELSE 'match_analysis: dynamic score ' || m || ' (' || CASE WHEN m = 0 THEN 'no positive components' ELSE 'backlog=' || m END || '); switched away from previous job_extraction ok; alternatives: job_extraction=' || CASE WHEN e = 0 THEN '0' WHEN e = 5 THEN '5' WHEN e = 2.5 THEN '2.5' ELSE rtrim(CAST(e AS VARCHAR), '0') END END || '.' AS rationale FROM s
""")
def scheduler_rationale(spark, d):
    """Two candidates per customer; ties go to the action nearer the end."""
    k = F.col("c_custkey")
    totals = F.array(F.struct(F.lit("match_analysis").alias("action"), (k % 8).cast("double").alias("total"), F.lit(1).alias("tie_rank")), F.struct(F.lit("job_extraction").alias("action"), ((k % 5) * 1.25).alias("total"), F.lit(2).alias("tie_rank")))
    rows = table(spark, d, "customer").select(k.alias("state"), F.explode(totals).alias("x")).select("state", "x.*").withColumns({"components": F.create_map(F.lit("backlog"), F.col("total"), F.lit("execution_cost"), F.lit(0.0)), "last_action": F.lit("job_extraction"), "last_status": F.lit("ok")})
    return features.rationale(rows, "state").select("state", "action", "rationale")


@query("""
SELECT n_name AS company_name, count(*) AS job_count, bool_or(s_acctbal > 5000) AS is_official, min_by(CASE WHEN s_acctbal > 0 THEN 't' || s_suppkey END, CASE WHEN s_acctbal > 0 THEN s_suppkey END) AS company_type, count(DISTINCT s_suppkey % 2) AS sources, string_agg(s_name, ',' ORDER BY s_suppkey) AS titles
FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def company_view(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    k = F.col("s_suppkey")
    jobs = s.select(k.alias("ord"), F.col("n_name").alias("company_name"), F.when(F.col("s_acctbal") > 0, F.concat(F.lit("t"), k.cast("string"))).alias("company_type"), (F.col("s_acctbal") > 5000).alias("is_official"), (k % 2).cast("string").alias("source_name"), F.lit("").alias("source_url"), F.col("s_name").alias("title"))
    return records.company_view(jobs).select("company_name", "job_count", "is_official", "company_type", F.size("source_names").cast("long").alias("sources"), F.array_join(F.col("jobs.title"), ",").alias("titles"))


@query("SELECT state, action, component, value FROM (SELECT n_nationkey AS state, 'web_search' AS action, unnest(['backlog', 'cost']) AS component, unnest([CAST(n_regionkey AS DOUBLE), CAST(-1.5 AS DOUBLE)]) AS value FROM nation)")
def score_rows(spark, d):
    rows = table(spark, d, "nation").select(F.col("n_nationkey").alias("state"), F.lit("web_search").alias("action"), F.create_map(F.lit("backlog"), F.col("n_regionkey").cast("double"), F.lit("cost"), F.lit(-1.5)).alias("components"))
    return records.score_rows(rows, "state", "action")


@query("SELECT o_orderkey AS \"job.id\", o_orderstatus AS \"job.state.now\", o_custkey AS who FROM orders")
def flat_features(spark, d):
    o = table(spark, d, "orders")
    return records.flattened(o.select(F.struct(F.col("o_orderkey").alias("id"), F.struct(F.col("o_orderstatus").alias("now")).alias("state")).alias("job"), F.col("o_custkey").alias("who")))


@query("SELECT s_suppkey AS id, n_name AS company, s_name AS title, s_nationkey::VARCHAR AS source FROM supplier JOIN nation ON s_nationkey = n_nationkey")
def jobs_grid(spark, d):
    none = F.lit(None).cast("string")
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    jobs = s.select(F.col("s_suppkey").alias("id"), F.col("n_name").alias("company_name"), none.alias("company_type"), F.col("s_name").alias("title"), none.alias("locations"), none.alias("status"), none.alias("notes"), none.alias("source_url"), F.col("s_nationkey").cast("string").alias("source_name"))
    return records.jobs_grid(jobs).select("id", "company", "title", "source")


@query("""
SELECT (SELECT count(*) FROM customer WHERE c_custkey % 9 > 0 AND c_acctbal >= 5000) AS inserted_count, (SELECT count(*) FROM customer WHERE c_custkey % 9 > 0 AND c_acctbal < 5000 AND c_acctbal > 1000) AS updated_count,
 (SELECT count(*) FROM customer WHERE c_custkey % 9 = 0 AND c_acctbal > 1000) AS failed_count
""")
def upsert_counts(spark, d):
    """Every ninth row lacks its company and is refused; the others go in."""
    c = table(spark, d, "customer")
    row = (F.col("c_name").alias("key"), F.when(F.col("c_custkey") % 9 > 0, F.lit("co")).alias("company_name"), F.lit("s").alias("status"))
    return records.upsert_counted(c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), *row), c.where("c_acctbal > 1000").select(*row), "key", ["status"], ["company_name"])[2]


@query("""
WITH b AS (SELECT 0 AS n, l_orderkey % 50 AS u, l_linestatus AS k, l_returnflag AS s, l_orderkey * 10 + l_linenumber AS o FROM lineitem WHERE l_linenumber < 3 UNION ALL SELECT 1, l_orderkey % 50, l_linestatus, l_returnflag, l_orderkey * 10 + l_linenumber FROM lineitem WHERE l_linenumber >= 3)
SELECT u AS url, k AS pending_kind, s AS stage, arg_max(o, n * 100000000000 + o) AS priority FROM b GROUP BY ALL
""")
def merged_followups(spark, d):
    rows = table(spark, d, "lineitem").select((F.col("l_orderkey") % 50).alias("url"), F.col("l_linestatus").alias("pending_kind"), F.col("l_returnflag").alias("stage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), "l_linenumber")
    rows = rows.withColumn("priority", F.col("ord"))
    return followups.merged_followups(rows.where("l_linenumber < 3"), rows.where("l_linenumber >= 3")).select("url", "pending_kind", "stage", "priority")


_RUN_ID = "'[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}'"


@query(f"""
SELECT doc_id, coalesce(regexp_full_match(text, {_RUN_ID}), false) AS text_valid, regexp_full_match(coalesce(source, '') || ':' || doc_id, {_RUN_ID}) AS name_valid, coalesce(regexp_full_match('-' || lang, {_RUN_ID}), false) AS dashed_valid, coalesce(regexp_full_match(repeat(lang, 64), {_RUN_ID}), false) AS long_valid FROM documents
""")
def run_ids(spark, d):
    """Whole texts, names of sources with an id, and names that begin wrongly or are as long as they may be."""
    docs = table(spark, d, "documents")
    named = F.concat(F.coalesce("source", F.lit("")), F.lit(":"), F.col("doc_id").cast("string"))
    return docs.select("doc_id", text.valid_run_id(F.col("text")).alias("text_valid"), text.valid_run_id(named).alias("name_valid"), text.valid_run_id(F.concat(F.lit("-"), "lang")).alias("dashed_valid"), text.valid_run_id(F.repeat("lang", 64)).alias("long_valid"))


@query("SELECT p_partkey, p_name || CASE WHEN p_brand = p_name THEN '' ELSE ',' || p_brand END || ',other' AS items FROM part")
def merged_items(spark, d):
    return table(spark, d, "part").select("p_partkey", F.array_join(text.merged_items(F.array("p_name", F.upper("p_name")), F.array(F.lower("p_name"), "p_brand"), F.array(F.lit("other"), F.lit("OTHER"))), ",").alias("items"))


@query("SELECT n_nationkey AS state, n_nationkey AS total_match_assessments, greatest(0, 8 - n_nationkey) AS result_deficit, greatest(0, 20 - n_nationkey) AS remaining_result_capacity FROM nation")
def fallback_features(spark, d):
    states = table(spark, d, "nation").select(F.col("n_nationkey").alias("state"), F.col("n_nationkey").cast("int").alias("matches"))
    return features.fallback_features(states, 8, 20).select("state", "total_match_assessments", "result_deficit", "remaining_result_capacity")
