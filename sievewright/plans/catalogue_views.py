"""Queries over what a person is shown, names of sources, errors of reports, and catalogues of places."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import locations, urls
from ..operators import displays, features, followups, pages, records, stages
from ..session import ready, table
from .availability import WORK
from .registry import registry

QUERIES, SQL, query = registry()


@query("""
SELECT o_orderkey AS id, coalesce(CASE WHEN c_acctbal > 0 AND c_mktsegment <> 'MACHINERY' THEN c_name END, CASE WHEN o_orderstatus = 'O' THEN 'own' END, 'Untitled role') AS title,
 CASE WHEN o_totalprice < 100000 THEN CAST(CAST(floor(o_totalprice / 1000) AS INT) AS VARCHAR) || '/100' ELSE '—' END AS score, CASE o_orderstatus WHEN 'F' THEN 'Low priority' WHEN 'O' THEN 'Apply' ELSE 'Some Other Code' END AS recommendation,
 CASE WHEN o_orderstatus = 'F' THEN 'a,b,c,d' ELSE 'gate' END AS reasons, CASE WHEN c_acctbal > 5000 THEN 'apply ' || c_custkey WHEN c_acctbal > 0 THEN 'source' END AS link
FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 0
""")
def assessment_cards(spark, d):
    """Orders as assessments, customers with money as jobs; some have no title, no score, only the gate's reasons."""
    status = F.col("o_orderstatus")
    told = table(spark, d, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("k"), F.when(status == "O", "own").alias("title"), F.lit(None).cast("string").alias("company_name"), F.when(F.col("o_totalprice") < 100000, F.floor(F.col("o_totalprice") / 1000).cast("int")).alias("match_score"),
        F.when(status == "F", "low_priority").when(status == "O", "apply").otherwise("some_other_code").alias("recommendation"), F.when(status == "F", F.array(*map(F.lit, "abcdef"))).otherwise(F.array().cast("array<string>")).alias("match_reasons"), F.array(F.lit("gate")).alias("deterministic_reasons"),
    )
    jobs = table(spark, d, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("k"), F.when(F.col("c_mktsegment") != "MACHINERY", F.col("c_name")).otherwise("").alias("title"), F.lit("").alias("company_name"), F.when(F.col("c_acctbal") > 5000, F.concat(F.lit("apply "), F.col("c_custkey").cast("string"))).alias("apply_url"), F.lit("source").alias("source_url"))
    ids = told.select("id", "k")
    got = displays.cards(told.withColumn("k", F.struct("id", "k")), ids.join(jobs, "k").withColumn("k", F.struct("id", "k")).drop("id"), "k")
    return got.select("k.id", "title", "score", "recommendation", F.array_join("reasons", ",").alias("reasons"), "link")


_STATE = "SELECT s_suppkey AS state, s_suppkey % 7 AS a, s_suppkey % 5 AS b, CASE WHEN s_acctbal < 0 THEN 'max_steps' END AS stop_reason FROM supplier"


@query(f"""
WITH s AS ({_STATE}), r AS (SELECT state, stop_reason, unnest(['acquire_page', 'analyze_page', 'job_extraction', 'explore_followups', 'job_understanding', 'match_analysis']) AS action, unnest([a, b, a + b, a, 0, 1]) AS pending, unnest([a, b, a + b, a // 2, 0, 1]) AS executable, unnest([3, 3, 0, 3, 3, 4]) AS batch_size FROM s)
SELECT state, action, pending, executable, batch_size, coalesce(round(executable / nullif(batch_size, 0), 2), 0) AS backlog_to_batch_ratio, executable > 0 AND stop_reason IS NULL AS available,
 action IN ('analyze_page', 'job_extraction', 'job_understanding', 'match_analysis') AS uses_llm, action = 'acquire_page' AS uses_network FROM r
""")
def backlog_frontier(spark, d):
    a, b = F.col("s_suppkey") % 7, F.col("s_suppkey") % 5
    given = {"acquire_page": a, "analyze_page": b, "job_extraction": a + b, "explore_followups": a, "job_understanding": F.lit(0), "match_analysis": F.lit(1)}
    sizes = {"job_extraction": 0, "match_analysis": 4}
    states = table(spark, d, "supplier").select(F.col("s_suppkey").alias("state"), F.when(F.col("s_acctbal") < 0, "max_steps").alias("stop_reason"), *(v.alias(f"pending_{k}") for k, v in given.items()), F.floor(a / 2).alias("executable_explore_followups"), *(F.lit(sizes.get(k, 3)).alias(f"batch_size_{k}") for k in given))
    return displays.backlog_rows(states, "state", tuple(WORK))


@query("""
SELECT s_suppkey AS state, unnest(range(6))::INT AS place, unnest(['Candidate sources', 'Acquired pages', 'Job detail pages', 'Prepared jobs', 'Understanding records', 'Match assessments']) AS stage, unnest([s_suppkey, s_nationkey, 0, 0, 0, 0]) AS n FROM supplier
""")
def stage_funnel(spark, d):
    counts = F.create_map(F.lit("candidate_sources"), F.col("s_suppkey").cast("long"), F.lit("acquired_pages"), F.col("s_nationkey").cast("long"), F.lit("errors"), F.lit(9).cast("long"))
    return displays.funnel(table(spark, d, "supplier").select(F.col("s_suppkey").alias("state"), counts.alias("counts")), "state")


@query("SELECT url, '' AS title, '' AS source_name, 'http' AS acquisition_method, length(html) AS html_length, 0 AS visible_text_length FROM pages")
def page_summaries(spark, d):
    return displays.page_rows(table(spark, d, "pages").withColumn("fetch_method", F.lit("http")))


@query("""
WITH f AS (SELECT event_type AS kind, user_id % 90 AS priority, event_id % 3 = 0 AS able, event_id % 2 = 0 AS official FROM events)
SELECT count(*) AS pending_count, count(*) FILTER (able) AS executable_count, avg(priority) AS mean_priority, max(priority) AS max_priority, count(*) FILTER (able AND priority >= 75) AS high_priority_executable_count, count(*) AS usable_link_count,
 count(*) FILTER (official) AS official_count, (SELECT string_agg(kind || '=' || n, ',' ORDER BY kind) FROM (SELECT kind, count(*) AS n FROM f GROUP BY kind)) AS kinds, (SELECT string_agg(p || '=' || n, ',' ORDER BY p) FROM (SELECT CAST(priority AS VARCHAR) AS p, count(*) AS n FROM f GROUP BY priority)) AS priorities, '' AS confidences FROM f
""")
def frontier_histograms(spark, d):
    """Events as follow-ups: counts of every value of every dimension, beside the aggregates."""
    none, k = F.lit(None).cast("string"), F.col("event_id")
    rows = table(spark, d, "events").select(F.col("event_type").alias("pending_kind"), none.alias("suggested_next_action"), F.lit("s").alias("stage"), (F.col("user_id") % 90).alias("priority"), (k % 2 == 0).alias("is_official"), F.array(F.lit("u"), F.lit("")).alias("links"), none.alias("page_type"), F.lit("").alias("confidence"), (k % 3 == 0).alias("executable"))
    text = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return features.frontier_features(rows).select("pending_count", "executable_count", "mean_priority", "max_priority", "high_priority_executable_count", "usable_link_count", "official_count", text("counts_by_pending_kind").alias("kinds"), text("priority_distribution").alias("priorities"), text("semantic_confidence_counts").alias("confidences"))


@query("""
WITH r AS (SELECT o_orderpriority <> '4-NOT SPECIFIED' AND o_orderstatus <> 'P' AS valid, o_custkey AS k FROM orders)
SELECT count(*) AS input_count, count(*) FILTER (valid) AS valid_count, count(*) FILTER (NOT valid) AS invalid_count, count(DISTINCT k) FILTER (valid) AS unique_count, count(*) FILTER (valid) - count(DISTINCT k) FILTER (valid) AS duplicate_count FROM r
""")
def preparation_counts(spark, d):
    title, url = F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", "T"), F.when(F.col("o_orderstatus") == "P", "ftp://x/y").otherwise("https://x.y/z")
    rows = table(spark, d, "orders").select(records.validation_reasons(title, url, F.lit(None).cast("string")).alias("reasons"), F.col("o_custkey").alias("k"))
    return records.preparation_counts(rows, "reasons", "k")


@query("""
WITH n AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]*)', 1) AS host FROM pages)
SELECT page_id, host AS followup, CASE WHEN page_id % 2 = 0 THEN 'Final.example' ELSE host END AS page, CASE page_id % 4 WHEN 0 THEN 'job ' || page_id WHEN 1 THEN 'mock' WHEN 2 THEN host ELSE 'T' END AS file FROM n
""")
def source_names(spark, d):
    """Names of sources: of a follow-up, of a page with a final address or without, of files and bare words."""
    k, s, none = F.col("page_id"), F.col("page_id").cast("string"), F.lit(None).cast("string")
    odd = F.when(k % 4 == 0, F.concat(F.lit("file:///data/job%20"), s, F.lit(".v.html"))).when(k % 4 == 1, F.lit("mock:x")).when(k % 4 == 2, F.col("url")).otherwise("plain words")
    final = F.when(k % 2 == 0, F.lit("https://Final.example/x?y")).otherwise(none)
    file = urls.source_of_file(odd, none, F.lit("T"))
    return table(spark, d, "pages").select("page_id", urls.source_of_followup(F.col("url")).alias("followup"), urls.source_of_page(F.col("url"), final, F.lit("T")).alias("page"), F.regexp_replace(file, "\\.v$", "").alias("file"))


@query("""
SELECT event_id, CASE WHEN event_type = 'click' THEN 'acquire_page' ELSE 'analyze_page' END AS stage, CASE WHEN event_type = 'click' OR event_type = 'view' THEN 'down ' || user_id WHEN event_type = 'purchase' THEN 'plain text' ELSE props END AS reason, CASE WHEN event_type = 'click' THEN 'https://a.b/' || user_id END AS url FROM events
""")
def report_errors(spark, d):
    """Errors as reports list them: with a stage of their own, without one, as a text, as an object without a reason."""
    kind, user = F.col("event_type"), F.concat(F.lit("down "), F.col("user_id").cast("string"))
    item = (
        F.when(kind == "click", F.to_json(F.struct(F.lit("acquire_page").alias("stage"), user.alias("reason"), F.concat(F.lit("https://a.b/"), F.col("user_id").cast("string")).alias("url"))))
        .when(kind == "view", F.to_json(F.struct(user.alias("reason")))).when(kind == "purchase", F.lit('"plain text"')).otherwise(F.col("props"))
    )
    return stages.reported_errors(table(spark, d, "events").select("event_id", item.alias("item")), "analyze_page").select("event_id", "stage", "reason", "url")


@query("""
WITH c AS (SELECT r_regionkey AS k, r_name AS province FROM region)
SELECT 'province' AS kind, k * 10000 AS ord, province AS name, '' AS home, CASE WHEN k % 2 = 0 THEN lower(province) ELSE 'a,b' END AS aliases FROM c
UNION ALL SELECT 'city', n_regionkey * 10000 + row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey), n_name, r_name, 'old ' || n_name FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL SELECT 'city', 1000000, 'Lone', '', '' UNION ALL SELECT 'province', 1010000, 'Far自治区', '', '' UNION ALL SELECT 'province', 1020000, 'Bare', '', ''
""")
def place_catalogue(spark, d):
    """Regions with their nations as one nested catalogue, with a bare name, a city of its own, a region that keeps its children, and entries of no use."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    child = F.struct(F.concat("n_name", F.lit(" City")).alias("name"), F.concat(F.lit("old "), "n_name").alias("alias"))
    sub = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", child.alias("c")))), lambda x: x["c"])
    each = n.groupBy("r_regionkey", "r_name").agg(sub.alias("children"))
    other = F.when(F.col("r_regionkey") % 2 == 0, F.to_json(F.struct(F.concat("r_name", F.lit(" Province")).alias("name"), F.lower("r_name").alias("aliases"), "children"))).otherwise(F.to_json(F.struct(F.concat("r_name", F.lit("省")).alias("name"), F.array(F.lit("a"), F.lit("b")).alias("aliases"), "children")))
    listed = each.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("r_regionkey", other.alias("j")))), lambda x: x["j"]), ",").alias("l"))
    pad = ",".join(["7"] * 95)  # so that what follows stands at the hundredth place
    rest = '"Lone City", {"name": "Far自治区", "children": [{"name": "x"}]}, {"name": "Bare"}, {"other": 1}, {"name": ""}, null'
    told = locations.parsed_catalog(listed.select(F.concat(F.lit('{"data":['), "l", F.lit(f",{pad},{rest}]}}")).alias("text")))
    return told.select(F.when(F.col("city").isNull(), "province").otherwise("city").alias("kind"), "ord", F.coalesce("city", "province").alias("name"), F.when(F.col("city").isNotNull(), F.coalesce("province", F.lit(""))).otherwise("").alias("home"), F.array_join("aliases", ",").alias("aliases"))


@query("""
WITH b AS (SELECT page_id, html, regexp_extract(html, '<article>(.*?)</article>', 1, 's') AS body FROM pages)
SELECT page_id, CASE WHEN length(trim(body)) >= 5000 THEN 'article' ELSE 'fallback_text' END AS method, CASE WHEN length(trim(body)) >= 5000 THEN body ELSE html END AS text FROM b
""")
def main_texts(spark, d):
    """An extractor's body where it is long enough, else the text at hand."""
    t = pages.main_text(F.regexp_extract("html", "(?s)<article>(.*?)</article>", 1), F.col("html"), 5000, "article")
    return table(spark, d, "pages").select("page_id", t.alias("t")).select("page_id", "t.method", "t.text")


@query("""
WITH k AS (SELECT page_id, lower(regexp_extract(url, '://([^/?#]*)', 1)) AS host FROM pages), f AS (SELECT host, min(page_id) AS fu, count(*) AS n FROM k GROUP BY host)
SELECT 'https://' || host || '/' AS url, CASE WHEN fu % 3 = 0 THEN 'Label' WHEN fu % 3 = 1 THEN 'T' || fu ELSE 'https://' || host || '/' END AS title, 's' || fu AS source_name, 80 AS relevance_score, 'href from follow-up p' || fu || ' (navigation_required)' AS reason FROM f
""")
def followup_sources(spark, d):
    """Every page is a follow-up that links to its host; the first one of a host gives the source its name."""
    ready(spark)
    k, s = F.col("page_id"), F.col("page_id").cast("string")
    home = F.concat(F.lit("https://"), F.lower(F.regexp_extract("url", "://([^/?#]*)", 1)), F.lit("/"))
    link = F.struct(F.lit(0).cast("long").alias("ord"), home.alias("url_key"), F.when(k % 3 == 0, " Label ").otherwise("").alias("text"))
    fus = table(spark, d, "pages").select(k.alias("fu"), F.concat(F.lit("p"), s).alias("url"), F.when(k % 3 == 1, F.concat(F.lit("T"), s)).otherwise("").alias("title"), F.concat(F.lit("s"), s).alias("source_name"), *(F.lit(None).cast("string").alias(c) for c in ("company_name", "company_type")), F.lit(True).alias("is_official"), F.lit(80).alias("priority"), F.lit("navigation_required").alias("pending_kind"), F.array(link).alias("links"))
    nothing = fus.where("false").select(F.col("url").alias("url_key"))
    found, _ = followups.explore(fus, nothing, nothing)
    return followups.candidate_sources(found, fus).select("url", "title", "source_name", "relevance_score", "reason")
