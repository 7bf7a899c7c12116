"""Runs over their own stage handlers, tables in buckets, upserts of batches with repeated keys, states told by content."""

import os

import pytest
from pyspark.sql import functions as F

from sievewright.operators import admission, records
from sievewright.plans import handlers, loop
from sievewright.plans.numbering import numbered
from sievewright.session import stored
from sievewright.sources import buckets, readers

JOB = "id long, deduplication_key string, company_name string, source_name string, status string"


def test_batch_goes_in_row_by_row(spark):
    """Of repeated keys the last facts count, of new ones the first row's status; numbers follow the order they came in."""
    old = spark.createDataFrame([(1, "a", 1, "seen"), (5, "z", 1, "sent")], "id long, key string, fact int, status string")
    new = spark.createDataFrame([("a", 2, "x", 0), ("b", 3, "first", 1), ("a", 4, "x", 2), ("A", 9, "x", 3), ("b", 5, "later", 4), ("b", None, "last", 5)], "key string, fact int, status string, ord int")
    got = [tuple(r) for r in records.upsert(old, new, "key", ["status"], order="ord").orderBy("id").collect()]
    assert got == [(1, "a", 4, "seen", "updated", 2), (5, "z", 1, "sent", "unchanged", 0), (6, "b", None, "first", "inserted", 3), (7, "A", 9, "x", "inserted", 1)]
    _, refused, counts = records.upsert_counted(old, new.unionByName(spark.createDataFrame([(None, 1, "x", 6), (" ", 1, "x", 7)], new.schema)), "key", ["status"], [], "ord")
    assert tuple(counts.first()) == (2, 4, 2) and refused.count() == 2
    empty = old.where("false")
    assert [tuple(r) for r in records.upsert(empty, new, "key", ["status"], order="ord").orderBy("id").select("id", "key").collect()] == [(1, "a"), (2, "b"), (3, "A")]
    assert records.upsert(old, new.where("false"), "key", ["status"], order="ord").where("action <> 'unchanged'").count() == 0


def test_numbering_sorts_once(spark):
    rows = spark.range(0, 5000, 1, 7).select((F.col("id") * 7919 % 5003).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    for per_range in (10**6, 300):
        out = numbered(rows, "k", "t", per_range=per_range)
        got = out.orderBy("row_no").collect()
        assert [r.row_no for r in got] == list(range(1, 5001)) and [r.k for r in got] == sorted(r.k for r in got)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "rangepartitioning" not in plan and "Sort [k" not in plan
    assert numbered(rows.where("false"), "k").count() == 0


def folders(path):
    return {os.path.relpath(os.path.join(d, f), path): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(f"{path}/data") for f in fs if f.startswith("part-")}


def test_upsert_leaves_other_buckets_alone(spark, tmp_path):
    path, rows = str(tmp_path / "jobs"), [(k, f"k{k}", "c", "s", "new") for k in range(200)]
    buckets.create_buckets(spark.createDataFrame(rows, JOB), path, "deduplication_key", buckets=32)
    before = folders(path)
    batch = spark.createDataFrame([("k3", "d", "s", "x", 0), ("k3", "e", "s", "x", 1), ("n1", "n", "s", "first", 2), ("n1", "m", "s", "x", 3), ("k9", None, "s", "x", 4), ("k10", " ", "s", "x", 5)], "deduplication_key string, company_name string, source_name string, status string, ord int")
    told, refused = buckets.upsert_buckets(spark, path, JOB, batch, "deduplication_key", ["status"], ["company_name", "source_name"], "ord")
    assert (told["inserted_count"], told["updated_count"], told["failed_count"], told["version"]) == (1, 3, 2, 1) and refused.count() == 2
    after = folders(path)
    assert before.items() <= after.items() and told["touched_buckets"] <= 4
    assert {f.split(os.sep)[2] for f in set(after) - set(before)} == {f"bucket={b.bucket}" for b in buckets.manifest(spark, path).where("held_by = 1").collect()}
    now = {r.deduplication_key: r for r in buckets.read_buckets(spark, path, JOB).collect()}
    assert len(now) == 201 and (now["k3"].id, now["k3"].company_name, now["k3"].status) == (3, "e", "new") and (now["n1"].id, now["n1"].company_name, now["n1"].status) == (200, "m", "first")
    assert {r.deduplication_key: r.company_name for r in buckets.read_buckets(spark, path, JOB, version=0).collect()}["k3"] == "c"
    some = buckets.read_buckets(spark, path, JOB, keys=spark.createDataFrame([("k3",)], "deduplication_key string"), key="deduplication_key")
    assert 1 <= some.count() < 60 and some.where("deduplication_key = 'k3'").count() == 1
    # A version that was cut off half way does not count.
    os.makedirs(f"{path}/manifest/version=2")
    assert buckets.read_buckets(spark, path, JOB).count() == 201
    with pytest.raises(KeyError):
        buckets.read_buckets(spark, path, JOB, version=7)


def test_bucket_that_only_refused_rows_touch_stays(spark, tmp_path):
    path = str(tmp_path / "jobs")
    buckets.create_buckets(spark.createDataFrame([], JOB), path, "deduplication_key", buckets=4)
    assert buckets.read_buckets(spark, path, JOB).count() == 0
    bad = spark.createDataFrame([("k", None, "s", "x")], "deduplication_key string, company_name string, source_name string, status string")
    assert buckets.upsert_buckets(spark, path, JOB, bad, "deduplication_key", ["status"], ["company_name"])[0]["failed_count"] == 1
    good = spark.createDataFrame([("k", "c", "s", "x"), ("l", "c", "s", "x")], bad.schema)
    assert buckets.upsert_buckets(spark, path, JOB, good, "deduplication_key", ["status"], ["company_name"])[0]["inserted_count"] == 2
    assert sorted((r.id, r.deduplication_key) for r in buckets.read_buckets(spark, path, JOB).collect()) == [(1, "k"), (2, "l")] and buckets.manifest(spark, path).count() == 4


PROSE = "We look for someone who builds things well, and who explains them to others in plain words. " * 4


def worker(spark, search, broken=()):
    """Handlers on answers that a table of pages holds."""
    say = lambda key, value: lambda asked: asked.select(key, F.lit(value).alias("answer"), F.lit(None).cast("string").alias("error"))
    html = F.concat(F.lit("<title>Page</title><p>"), F.lit(PROSE), F.lit("</p><a href='/jobs/next'>View job</a>"))
    fetch = lambda rows: rows.select("url", F.col("url").alias("final_url"), html.alias("html"), F.lit(200).alias("status_code"), F.lit(None).cast("string").alias("fetch_error"))
    ask = {
        "analyze_page": say("url", '{"page_type": "job_detail"}'), "job_extraction": say("url", '{"page_context": {"deadline": "2030-01-01"}, "jobs": [{"title": "T", "description": "d", "requirements": "r", "locations": ["Sydney"]}]}'),
        "job_understanding": say("deduplication_key", '{"canonical_role": "r", "confidence": "high"}'), "match_analysis": say("deduplication_key", '{"role_fit": "high", "must_have_fit": "yes", "confidence": "high"}'),
    }
    profile = readers.profile(spark, {"education": "硕士", "graduation_date": "2026-10", "target_roles": ["dev"], "skills": ["x"], "preferred_locations": ["Sydney"]})
    return handlers.Handlers(profile, "2026-01-01", search, fetch, ask | dict.fromkeys(broken, lambda asked: 1 / 0))


def found(*urls):
    return lambda queries: queries.limit(1).select(F.posexplode(F.array(*map(F.lit, urls))).alias("ord", "url")).select(F.col("ord").cast("long").alias("ord"), F.lit("").alias("title"), "url", F.lit("c").alias("content"), F.lit(0.5).alias("score"))


def test_run_searches_for_its_sources(spark, tmp_path):
    """From nothing but a profile: a plan, a search, two sources of which one comes twice, and so on to assessments."""
    work = worker(spark, found("https://a.b/1?utm_source=x", "https://a.b/1", " ", "https://a.b/2"))
    run = loop.drive(handlers.started(spark, str(tmp_path), batch=5, max_search_rounds=1, soft_target=2), work.bound(), handlers.pending, features=handlers.run_features)
    assert [t["action"] for t in run.trace] == ["build_search_plan", "web_search", "acquire_page", "analyze_page", "job_extraction", "job_understanding", "match_analysis", "stop"]
    assert sorted(r.deduplication_key for r in run.tables["match_assessments"].collect()) == ["url|https a b 1", "url|https a b 2"] and run.facts["stop_reason"] == "frontier_exhausted"
    told = {r.action: (r.outcome, r.signals) for r in loop.steps(spark, str(tmp_path)).collect()}
    assert told["build_search_plan"] == ("progress", ["plan_created"]) and told["web_search"] == ("progress", ["progress", "new_acquisition_work"]) and told["acquire_page"][1] == ["page_acquired"]
    again = loop.resume(spark, str(tmp_path), work.bound(), handlers.pending, features=handlers.run_features)
    assert again.facts["stop_reason"] == "frontier_exhausted" and again.counts == run.counts and again.digests == run.digests


def test_failed_steps_leave_tables_alone(spark, tmp_path):
    """A stage that fails changes nothing and is tried again, until its calls are used up and nothing else can be done; a failed search is an error."""
    work = worker(spark, found("https://a.b/1"), broken=("job_extraction",))
    queue = spark.createDataFrame([(0, "https://a.b/1", "t"), (1, "https://A.B/1?gclid=3", "t"), (2, "", "t")], "ord long, url string, title string")
    run = handlers.started(spark, str(tmp_path / "a"), queue, batch=5, max_search_rounds=0, calls={"job_extraction": 2}, max_steps=8)
    with pytest.raises(ValueError, match="no available action"):
        loop.drive(run, work.bound(), handlers.pending, features=handlers.run_features)
    assert [t["action"] for t in run.trace] == ["acquire_page", "analyze_page", "job_extraction", "job_extraction"] and run.counts["extracted_pages"] == 0 and run.counts["acquired_pages"] == 1
    assert len(run.facts["errors"]) == 2 and "ZeroDivisionError" in run.facts["errors"][0] and run.last["outcome"] == "error"

    def down(queries):
        raise OSError("no network")

    run = handlers.started(spark, str(tmp_path / "b"), batch=5)
    run = loop.drive(run, worker(spark, down).bound(), handlers.pending, features=handlers.run_features)
    assert run.facts["last_search"] == "error" and run.facts["stop_reason"] and "no network" in run.tables["errors"].first().reason


def test_scheduling_features_come_from_tables(spark, tmp_path):
    run = handlers.started(spark, str(tmp_path))
    fu = [(0, "https://a.b/l", "navigation_required", 80, [("https://a.b/new", "x", "job_detail_candidate"), ("https://a.b/old", "x", "apply")], "pre_extraction"), (1, "https://a.b/m", "navigation_required", 60, [("https://a.b/old", "x", "apply")], "pre_extraction"), (2, "https://a.b/n", "review_required", 40, [], "pre_extraction")]
    run.tables["pending_followups"] = handlers.complete(spark.createDataFrame(fu, "ord long, url string, pending_kind string, priority int, links array<struct<url:string,text:string,kind:string>>, stage string"), handlers.TABLES["pending_followups"])
    run.tables["explored_links"] = spark.createDataFrame([("https://a.b/old",)], "url_key string")
    run.tables["selected_sources"] = spark.createDataFrame([("u",), ("v",)], "url string")
    got = handlers.run_features(run)
    assert got["executable"]["explore_followups"] == 1 and got["mean_priority"] == 60.0 and got["frontier_high"] == 1 and got["yields"]["explore_followups"] == 2.0 and got["yields"]["job_extraction"] is None
    run.last = {"action": "explore_followups", "growth": {"selected_sources": 1, "explored_links": 4}}
    assert handlers.run_features(run)["yields"]["explore_followups"] == 0.25


def test_states_are_told_by_content(spark, tmp_path):
    """An update in place changes a state though no count changes; a state finds its own entry of the trace."""
    rows = lambda *xs: spark.createDataFrame([(x, {"k": x}) for x in xs], "url string, more map<string,string>")
    digest = lambda df: df.agg(loop.digest(df).alias("d")).first().d
    assert digest(rows("a", "b")) == digest(rows("b", "a").repartition(3)) != digest(rows("a", "c")) and digest(rows("a", "a")) != digest(rows("a")) and digest(rows()) == "0"
    run = loop.Run(spark, str(tmp_path), {"acquisition_queue": rows("a")}, {"has_plan": True, "search_rounds": 3}, {"max_steps": 2, "max_results": 20, "soft_target": 8, "batch": 3, "max_search_rounds": 3})
    turn = iter("xy")
    done = loop.drive(run, {"acquire_page": lambda r: {"acquisition_queue": rows(next(turn))}}, lambda r: {"acquire_page": 1})
    assert done.facts["stop_reason"] == "max_steps" and done.step == 2
    told = loop.steps(spark, str(tmp_path)).select("step", F.lit(3).alias("search_round"), "action", loop.state_key(F.col("digests")).alias("state"))
    told = stored(told, "told")
    first = told.where("step = 0").select("search_round", "state")
    other = first.withColumn("state", F.lit("unknown"))
    assert loop.trace_entry(told, first, state="state").first().entry.step == 0 and loop.trace_entry(told, other, state="state").first().entry.step == 1
    with pytest.raises(loop.NoProgress):
        loop.drive(loop.Run(spark, str(tmp_path / "same"), {"acquisition_queue": rows("a")}, {"has_plan": True, "search_rounds": 3}), {"acquire_page": lambda r: {"acquisition_queue": rows("a")}}, lambda r: {"acquire_page": 1})


def test_search_answers_without_a_limit(spark):
    rows = spark.createDataFrame([(k, "", f"u{k % 7}", f"u{k % 7}", "c", 0.5) for k in range(30)] + [(90, "t", " ", "x", "c", 0.1)], "ord long, title string, url string, url_key string, content string, score double")
    assert [r.ord for r in admission.searched(rows).orderBy("ord").collect()] == list(range(7)) == [r.ord for r in admission.searched(rows, 20_000).orderBy("ord").collect()]
    assert [r.ord for r in admission.searched(rows, 2).orderBy("ord").collect()] == [0, 1]


def test_search_results_of_repeated_addresses(spark, tmp_path):
    """As many sources as pages, as in the SQL: repeated, blank and missing addresses stay."""
    import duckdb

    from sievewright.plans import catalogue

    pages = [(1, "https://a/x", "<p>one</p>"), (2, "https://a/x", "<p>two</p>" * 2000), (3, "https://a/x", "<p>one</p>"), (4, " ", "é" * 1001), (5, None, ""), (6, "https://a/y", None), (6, "https://a/y", None)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    got = [tuple(r) for r in catalogue.queries()["search_results"](spark, str(tmp_path)).select("ord", "url", "title", "relevance_score", "reason").collect()]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = db.execute(f"SELECT ord, url, title, relevance_score, reason FROM ({catalogue.oracle_sql()['search_results']})").fetchall()
    assert len(got) == 7 and sorted(got, key=str) == sorted(want, key=str)
