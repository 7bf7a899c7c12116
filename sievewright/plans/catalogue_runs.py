"""Queries over whole runs: from sources to assessments on recorded answers, and what a run tells of itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import features, stages
from ..session import ready, shared_folder, table
from ..sources import artifacts, readers, web
from ..streaming import admission
from . import handlers, loop
from .catalogue_pages import ADMIT, keyed_pages
from .registry import registry

QUERIES, SQL, query = registry()

_PROSE = "We look for someone who builds things well, and who explains them to others in plain words. Duties of role {k} are told here at length, so that a page holds enough text to be read. "


def _text(k):
    """What the page of source ``k`` shows; some pages show too little."""
    return F.when(k % 11 == 5, F.lit("<p>Too short.</p>")).otherwise(F.concat(F.lit("<p>"), F.repeat(F.replace(F.lit(_PROSE), F.lit("{k}"), k.cast("string")), 3), F.lit("</p>")))


class _Recorded:
    """Answers by the number at the end of an address, as tables that Spark makes from what is asked."""

    def __init__(self, spark, d):
        self.spark = spark
        self.first = table(spark, d, "supplier").select(F.col("s_suppkey").cast("long").alias("k"))

    @staticmethod
    def number(url):
        return F.regexp_extract(url, "([0-9]+)$", 1).cast("long")

    def search(self, queries):
        """No search: the run begins with its sources."""
        return queries.select(F.lit(0).cast("long").alias("ord"), F.lit("").alias("title"), F.lit("").alias("url"), F.lit("").alias("content"), F.lit(0.0).alias("score")).where("false")

    def fetch(self, rows):
        """Every thirteenth source is down; listings link to one page of their own, and a third of the others to an application that twenty of them share."""
        k = self.number(F.col("url"))
        link = F.when(F.contains("url", F.lit("/list/")), F.concat(F.lit('<a href="/jobs/'), (k + 100000).cast("string"), F.lit('">View job</a>'))).otherwise("")
        apply = F.when((k % 3 == 1) & ~F.contains("url", F.lit("/list/")), F.concat(F.lit('<a href="https://apply.example/shared/'), F.floor(k / 20).cast("string"), F.lit('">Apply now</a>'))).otherwise("")
        html = F.concat(F.lit("<html><head><title>Role "), k.cast("string"), F.lit("</title></head><body>"), _text(k), link, apply, F.lit("</body></html>"))
        down = k % 13 == 7
        return rows.select("url", F.col("url").alias("final_url"), F.when(~down, html).alias("html"), F.when(~down, 200).alias("status_code"), F.when(down, "OSError: no answer").alias("fetch_error"))

    def classify(self, asked):
        k = self.number(F.col("url"))
        kind = F.when(F.contains("url", F.lit("/list/")), "job_listing").when(k % 7 == 3, "irrelevant").otherwise("job_detail")
        answer = F.when(k % 17 == 4, "no json").otherwise(F.to_json(F.struct(kind.alias("page_type"), F.lit("x").alias("suggested_next_action"))))
        return asked.select("url", answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    def extract(self, asked):
        """Two jobs a page, alike but for their titles; every fifth page's deadline is over, every nineteenth page has no job."""
        k = self.number(F.col("url"))
        job = lambda title: F.struct(F.lit(title).alias("title"), F.array(F.when(k % 4 == 0, "Perth").otherwise("Sydney")).alias("locations"), F.lit("what to do").alias("description"), F.lit("what to know").alias("requirements"))
        jobs = F.array(job("First role"), job("Second role"))
        context = F.struct(F.concat(F.lit("Company "), (k % 3).cast("string")).alias("company_name"), F.lit("campus").alias("recruitment_type"), F.when(k % 5 == 2, "2020-01-01").alias("deadline"))
        answer = F.to_json(F.struct(F.col("url").alias("page_id"), context.alias("page_context"), F.when(k % 19 == 6, F.slice(jobs, 1, 0)).otherwise(jobs).alias("jobs")))
        return asked.select("url", answer.alias("answer"), F.lit(None).cast("string").alias("error"))

    def understand(self, asked):
        k = self.number(F.col("deduplication_key"))
        answer = F.to_json(F.struct(F.lit("builder").alias("canonical_role"), F.lit("graduate").alias("seniority"), F.lit("high").alias("confidence")))
        return asked.select("deduplication_key", F.when(k % 23 != 9, answer).alias("answer"), F.when(k % 23 == 9, "provider down").alias("error"))

    def match(self, asked):
        k = self.number(F.col("deduplication_key"))
        answer = F.to_json(F.struct(F.when(k % 2 == 0, "high").otherwise("low").alias("role_fit"), F.when(k % 3 == 0, "yes").otherwise("partial").alias("must_have_fit"), F.lit("high").alias("confidence"), F.array(F.lit("fits")).alias("match_reasons")))
        return asked.select("deduplication_key", answer.alias("answer"), F.lit(None).cast("string").alias("error"))


def whole_run(spark, d, path=None, **limits):
    """A run over all suppliers as sources, driven to its end."""
    ready(spark)
    told = _Recorded(spark, d)
    profile = readers.profile(spark, {"education": "硕士", "graduation_date": "2026-10", "target_roles": ["builder"], "skills": ["words"], "preferred_locations": ["Sydney"], "excluded_locations": ["Nowhere"]})
    work = handlers.Handlers(profile, "2026-01-01", told.search, told.fetch, {"analyze_page": told.classify, "job_extraction": told.extract, "job_understanding": told.understand, "match_analysis": told.match})
    s = F.col("k").cast("string")
    queue = told.first.select(F.col("k").alias("ord"), F.concat(F.when(F.col("k") % 6 == 1, "https://list.example/list/").otherwise("https://one.example/jobs/"), s, F.lit("?utm_source=x")).alias("url"), F.lit("T").alias("title"), F.lit("S").alias("source_name"), (F.col("k") % 2 == 0).alias("is_official"))
    run = handlers.started(spark, path or shared_folder(spark, "run"), queue, **({"batch": 1_000_000, "soft_target": 10**9, "max_results": 10**9, "max_search_rounds": 0} | limits))
    run.facts |= {"has_plan": True, "search_rounds": 0}
    return loop.drive(run, work.bound(), handlers.pending, features=handlers.run_features)


_RUN = """
WITH s AS (SELECT s_suppkey AS k, CASE WHEN s_suppkey % 6 = 1 THEN 'list' ELSE 'one' END AS kind, s_suppkey % 2 = 0 AS official, s_suppkey AS ord FROM supplier),
f AS (SELECT *, k % 13 = 7 AS down, k % 11 = 5 AS short, k % 17 = 4 AS lost FROM s),
l AS (SELECT k + 100000 AS k, 'list' AS kind, official, ord FROM f WHERE kind = 'list' AND NOT down AND NOT short AND NOT lost),
g AS (SELECT k, kind, official, 1 AS wave, ord FROM s UNION ALL SELECT k, 'found', official, 2, ord FROM l),
p AS (SELECT *, k % 13 = 7 AS down, k % 11 = 5 AS short, k % 17 = 4 AS lost FROM g),
jd AS (SELECT * FROM p WHERE kind <> 'list' AND NOT down AND NOT short AND NOT lost AND k % 7 <> 3),
j AS (SELECT k, wave, ord, official, CASE WHEN k % 3 = 1 THEN 'url|https apply example shared ' || (k // 20) WHEN wave = 1 THEN 'url|https one example jobs ' || k ELSE 'url|https list example jobs ' || k END AS key, CASE WHEN k % 3 = 1 THEN k // 20 ELSE k END AS num, k % 5 = 2 AS late, k % 4 = 0 AS perth
      FROM jd WHERE k % 19 <> 6),
u AS (SELECT *, row_number() OVER (PARTITION BY wave, key ORDER BY official DESC, late DESC, ord) AS nth FROM j),
b AS (SELECT * FROM u WHERE nth = 1 AND NOT late),
w AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY wave DESC) AS last, min(wave) OVER (PARTITION BY key) AS first FROM b),
x AS (SELECT * FROM w WHERE last = 1 AND num % 23 <> 9)
"""


@query(_RUN + """
SELECT 'assessment' AS part, key AS name, (35 * CASE WHEN num % 2 = 0 THEN 100 ELSE 20 END + 25 * CASE WHEN num % 3 = 0 THEN 100 ELSE 60 END + 20 * 70 + 10 * CASE WHEN perth THEN 50 ELSE 100 END) // 90 AS value, official FROM x
UNION ALL SELECT 'table', * , NULL FROM (SELECT 'acquired_pages' AS name, count(*) FILTER (NOT down) AS n FROM p UNION ALL SELECT 'rejected_pages', count(*) FILTER (NOT down AND short) FROM p UNION ALL SELECT 'job_detail_pages', count(*) FROM jd
 UNION ALL SELECT 'errors', (SELECT count(*) FROM p WHERE down OR (NOT short AND lost)) + (SELECT count(*) FROM w WHERE last = 1 AND num % 23 = 9) UNION ALL SELECT 'prepared_jobs', count(DISTINCT key) FROM b
 UNION ALL SELECT 'understanding_records', count(*) FROM x UNION ALL SELECT 'match_assessments', count(*) FROM x UNION ALL SELECT 'acquisition_queue', 0
 UNION ALL SELECT 'pending_followups', count(*) FILTER (NOT down AND NOT short AND (lost OR (kind <> 'list' AND (k % 7 = 3 OR k % 19 = 6)))) FROM p UNION ALL SELECT 'explored_links', count(*) FROM l)
""")
def whole_runs(spark, d):
    """What a run comes to: every job of every page that lets itself be fetched, read and understood, scored; and the rows of the run's tables."""
    run = whole_run(spark, d)
    names = ("acquired_pages", "rejected_pages", "job_detail_pages", "errors", "prepared_jobs", "understanding_records", "match_assessments", "acquisition_queue", "pending_followups", "explored_links")
    told = loop.steps(spark, run.path).orderBy(F.desc("step")).limit(1).select(F.explode("counts").alias("name", "value")).where(F.col("name").isin(*names))
    scored = run.tables["match_assessments"].select(F.lit("assessment").alias("part"), F.col("deduplication_key").alias("name"), F.col("match_score").cast("long").alias("value"), (F.element_at("risk_flags", -1) != "non_official_source").alias("official"))
    return scored.unionByName(told.select(F.lit("table").alias("part"), "name", "value", F.lit(None).cast("boolean").alias("official")))


_ASKED = """
WITH b AS (SELECT page_id, (row_number() OVER (ORDER BY page_id) - 1) // 4 AS batch FROM pages),
t AS (SELECT *, CASE batch % 5 WHEN 1 THEN 2 WHEN 2 THEN 3 WHEN 3 THEN 9 ELSE 1 END AS good FROM b)
"""


def _repaired(spark, d):
    """Batches of four pages: some answers are no JSON at first, some repeat a page twice, some never hold all pages."""
    s, none = F.col("page_id").cast("string"), F.lit(None).cast("string")
    pages = table(spark, d, "pages").select(
        s.alias("page_id"), F.col("page_id").alias("ord"), F.concat(F.lit("https://j.example/"), s).alias("url"), F.lit("src").alias("source_name"), none.alias("source_company_name"), none.alias("company_type"), none.alias("source_location"),
        F.lit(True).alias("is_official"), F.lit("T").alias("title"), F.substring("html", 1, 40).alias("visible_text"), F.array().cast("array<struct<url:string,text:string,kind:string>>").alias("important_links"),
    )
    pages = stages.batched(pages, "ord", 4)

    def ask(requests):
        shown = F.from_json(F.substring_index("prompt", "Input:\n", -1), "pages array<struct<page_id:string>>")["pages"]
        entry = lambda x: F.struct(x["page_id"].alias("page_id"), F.struct(F.lit("Co").alias("company_name")).alias("page_context"), F.array(F.struct(F.concat(F.lit("Role "), x["page_id"]).alias("title"))).alias("jobs"))
        right, kind = F.transform(shown, entry), F.col("batch") % 5
        twice = F.concat(F.slice(right, 1, 1), right)
        answer = F.when((kind == 1) & (F.col("attempt") < 2), "sorry").when((kind == 2) & (F.col("attempt") < 3), F.to_json(twice)).when(kind == 3, F.to_json(F.slice(right, 2, 9))).otherwise(F.to_json(right))
        return requests.select("batch", answer.alias("answer"), none.alias("error"))

    return stages.extracted_with_repair(pages, ask, "Extract the jobs.", attempts=3, order="ord")


@query(_ASKED + """
SELECT CAST(page_id AS VARCHAR) AS page_id, CASE WHEN good <= 3 THEN 'Role ' || page_id END AS title, CASE WHEN good > 3 THEN 'AI extraction page_id values do not match the input pages.' END AS reason FROM t
""")
def answer_repair(spark, d):
    """Pages whose batch held in one of three attempts have their jobs, the others one error each."""
    raw, errors, _ = _repaired(spark, d)
    page = F.regexp_extract("source_url", "([0-9]+)$", 1)
    return raw.select(page.alias("page_id"), "title", F.lit(None).cast("string").alias("reason")).unionByName(errors.select("page_id", F.lit(None).cast("string").alias("title"), "reason"))


@query(_ASKED + """
, n AS (SELECT DISTINCT batch, good FROM t)
SELECT a AS attempt, count(*) FILTER (good >= a) AS asked, count(*) FILTER (good = a) AS usable FROM n, (SELECT unnest([1, 2, 3])::INT AS a) GROUP BY a
""")
def repair_report(spark, d):
    """Only batches that did not hold are asked again."""
    return _repaired(spark, d)[2]


_TITLE = "trim(regexp_replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&quot;', chr(34)), '&copy;', '©'), '&amp;?', '&', 'g'))"


def _two_passes(spark, d):
    """Every third page is a shell of scripts at first, every fifth is down at first, every fifteenth is down for a browser too."""
    ready(spark)
    p = table(spark, d, "pages").withColumn("url", F.concat(F.lit("https://h.example/"), F.col("page_id").cast("string")))
    none = F.lit(None).cast("string")

    def response(rows, body, error, method):
        d = rows.join(p, "url")
        return d.select("url", F.when(error.isNull(), F.encode(body, "UTF-8")).alias("body"), F.when(error.isNull(), 200).alias("status_code"), F.when(error.isNull(), F.col("url")).alias("final_url"), F.lit("text/html; charset=utf-8").alias("content_type"), F.lit("").alias("content_encoding"), F.lit(1).alias("attempts"), F.lit(method).alias("fetch_method"), error.alias("fetch_error"))

    k = F.col("page_id")
    shell = F.when(k % 3 == 1, F.lit("<html><body><div id='root'></div></body></html>")).otherwise(F.col("html"))
    fetch = lambda rows: response(rows, shell, F.when(k % 5 == 2, F.lit("OSError: no answer")).otherwise(none), "http")
    render = lambda rows: response(rows, F.col("html"), F.when(k % 15 == 7, F.lit("OSError: no page")).otherwise(none), "browser")
    return readers.acquire(p.select("url"), fetch, render)


_PASSES = """
WITH t AS (SELECT page_id, html, page_id % 5 = 2 AS down, page_id % 3 = 1 AS shell, page_id % 15 = 7 AS dead FROM pages)
"""


@query(_PASSES + """
SELECT 'https://h.example/' || page_id AS url, CASE WHEN (down OR shell) AND NOT dead THEN 'browser' ELSE 'http' END AS fetch_method, CASE WHEN NOT dead THEN length(html) END AS size,
 CASE WHEN dead THEN 'OSError: no answer; browser: OSError: no page' END AS fetch_error, CASE WHEN NOT dead THEN len(regexp_extract_all(html, '<a href="([^"]*)">[^<]*</a>', 1)) END AS n_links FROM t
""")
def two_pass_pages(spark, d):
    """Whole pages; those with a flaw are fetched a second time, and what counts in the end is parsed once."""
    pages, _ = _two_passes(spark, d)
    return pages.select("url", "fetch_method", F.length("html").cast("long").alias("size"), "fetch_error", F.when(F.col("fetch_error").isNull(), F.size("links")).cast("long").alias("n_links"))


@query(_PASSES + "SELECT count(*) AS sources, count(*) FILTER ((down OR shell) AND NOT dead) AS rendered, count(*) FILTER (dead) AS failed, count(*) FILTER (NOT dead) AS clean, 0 AS flawed FROM t")
def two_pass_counts(spark, d):
    return _two_passes(spark, d)[1].select("sources", "rendered", "failed", F.col("clean"), "flawed")


@query("SELECT doc_id, text, lang, source, n_chars, lang || '/' || source AS keys FROM documents")
def artifact_round_trip(spark, d):
    """All documents into an artifact of as many files as they take, and back."""
    path = shared_folder(spark, "artifact") + "/documents"
    docs = table(spark, d, "documents").withColumn("keys", F.array("lang", "source"))
    artifacts.write_parts(docs, path)
    back = readers.json_parts(spark, path, "doc_id long, text string, lang string, source string, n_chars long, keys array<string>")
    return back.withColumn("keys", F.concat(F.col("keys")[0], F.lit("/"), F.col("keys")[1]))  # null where either is, as in SQL


@query("""
WITH e AS (SELECT l_returnflag AS stage, l_orderkey * 10 + l_linenumber AS ord, CASE WHEN l_tax > 0.06 THEN 'tax ' || CAST(l_linenumber AS VARCHAR) END AS error FROM lineitem),
r AS (SELECT *, row_number() OVER (PARTITION BY stage ORDER BY ord, error) AS n FROM e WHERE error IS NOT NULL)
SELECT e.stage, count(*) AS total, count(*) FILTER (e.error IS NULL) AS succeeded, count(*) FILTER (e.error IS NOT NULL) AS failed, (SELECT string_agg(r.ord || ' ' || r.error, ';' ORDER BY n) FROM r WHERE r.stage = e.stage AND n <= 5) AS first_errors FROM e GROUP BY e.stage
""")
def stage_errors(spark, d):
    """Stages with thousands of errors: exact counts, and the first five as rows."""
    rows = table(spark, d, "lineitem").select(F.col("l_returnflag").alias("stage"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ord"), F.when(F.col("l_tax") > 0.06, F.concat(F.lit("tax "), F.col("l_linenumber").cast("string"))).alias("error"))
    told = features.stage_report(rows.withColumn("ok", F.col("error").isNull()), ["stage"], "ok", "error", "ord", 5)
    return told.select("stage", "total", "succeeded", "failed", F.array_join(F.transform("first_errors", lambda e: F.concat(e["at"].cast("string"), F.lit(" "), e["error"])), ";").alias("first_errors"))


@query("""
WITH q AS (SELECT n_name AS query, row_number() OVER (ORDER BY n_name) - 1 AS idx FROM nation),
a AS (SELECT n_name AS query, s_name AS url, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS title, least(greatest(s_acctbal, 0), 9999) / 9999 AS score, row_number() OVER (PARTITION BY n_name ORDER BY s_suppkey) - 1 AS rank FROM supplier JOIN nation ON s_nationkey = n_nationkey)
SELECT idx * 1000000 + rank AS ord, query, url, title, round(score, 6) AS score FROM a JOIN q USING (query) WHERE rank < 110 // 25 + CASE WHEN idx < 110 % 25 THEN 1 ELSE 0 END
""")
def searched_source(spark, d):
    """Nations as queries, their suppliers as recorded answers: a task per query, which keeps to its quota of 110 answers in all."""
    nation = table(spark, d, "nation")
    path = shared_folder(spark, "search-answers")
    s = table(spark, d, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey"))
    score = F.least(F.greatest(F.col("s_acctbal"), F.lit(0.0)), F.lit(9999.0)) / 9999
    s.select(F.col("n_name").alias("query"), F.col("s_suppkey").alias("rank"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).otherwise("").alias("title"), F.col("s_name").alias("url"), F.lit("c").alias("content"), score.alias("score")).write.parquet(path)
    queries = sorted(r[0] for r in nation.select("n_name").collect())  # a plan's queries: few
    found = web.search(spark, queries, "sievewright.sources.web:recorded_search", 110, answers=path if "://" in path else f"file://{path}")
    return found.select("ord", "query", "url", "title", F.round("score", 6).alias("score"))


@query(ADMIT + "SELECT ord, url_key, outcome FROM o")
def streamed_admission(spark, d):
    """What admission of all pages at once comes to, by a stream: every page in a first batch, and again in a second one that finds only state."""
    pages = keyed_pages(spark, d)
    path = shared_folder(spark, "admission")

    def turn(rows, part):
        rows.write.parquet(f"{path}/in/{part}")
        stream = spark.readStream.schema("ord long, url_key string").option("recursiveFileLookup", True).parquet(f"{path}/in")
        query_ = admission.admit_stream(stream, f"{path}/out", f"{path}/checkpoint", limit=100, queued=pages.where("size > 6000"), handled=pages.where("size < 1500"))
        query_.awaitTermination()

    turn(pages.select(F.col("page_id").alias("ord"), "url_key"), "a")
    turn(pages.select((F.col("page_id") + 1000000).alias("ord"), "url_key"), "b")
    return admission.judged(spark, f"{path}/out").select("ord", "url_key", "outcome")


@query("""
WITH c AS (SELECT c_custkey AS k FROM customer WHERE c_acctbal > -500), j AS (SELECT k FROM c JOIN customer ON k = c_custkey WHERE c_nationkey < 20)
SELECT 'resumed' AS part, k FROM j JOIN customer ON k = c_custkey WHERE c_mktsegment <> 'MACHINERY' UNION ALL SELECT 'replayed', k FROM c
""")
def replayed_run(spark, d):
    """A run over customers that pauses after a step and is resumed from what it stored; and the step after that, done again in a folder of its own."""
    path = shared_folder(spark, "resumed")
    flow = {
        "acquire_page": ("acquisition_queue", "acquired_pages", "true"), "analyze_page": ("acquired_pages", "job_detail_pages", "c_acctbal > -500"), "job_extraction": ("job_detail_pages", "prepared_jobs", "c_nationkey < 20"),
        "job_understanding": ("prepared_jobs", "understanding_records", "c_mktsegment <> 'MACHINERY'"), "match_analysis": ("understanding_records", "match_assessments", "true"),
    }

    def stage(source, target, keeps):
        return lambda r: {target: r.tables[source].where(keeps)} | ({source: r.tables[source].where("false")} if source == "acquisition_queue" else {})

    def pending(r):
        """A stage has its whole source to do until its target is there."""
        return {a: r.counts.get(s, 0) if t not in r.counts else 0 for a, (s, t, _) in flow.items()}

    stages_ = {a: stage(*x) for a, x in flow.items()}
    first = loop.Run(spark, path, {"acquisition_queue": table(spark, d, "customer")}, {"has_plan": True, "search_rounds": 3}, {"max_steps": 25, "max_results": 10**9, "soft_target": 8, "batch": 3, "max_search_rounds": 3})
    loop.drive(first, stages_, pending, pause_after=True)
    done = loop.resume(spark, path, stages_, pending)
    again = loop.replay(spark, path, 0, f"{path}-again", stages_, pending)
    return done.tables["match_assessments"].select(F.lit("resumed").alias("part"), F.col("c_custkey").alias("k")).unionByName(again.tables["job_detail_pages"].select(F.lit("replayed").alias("part"), F.col("c_custkey").alias("k")))
