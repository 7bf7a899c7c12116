import pytest
from pyspark.sql import functions as F

from sievewright.operators import admission, eligibility, features, followups, pages, records, stages
from sievewright.plans import availability, loop, search_plan, tools
from sievewright.sources import providers, readers, sinks
from sievewright.streaming import backlog


def test_admission_precedence(spark):
    """A repeat of a limited address is limited, not a duplicate."""
    rows = [(0, None), (1, "h"), (2, "q"), (3, "a"), (4, "a"), (5, "b"), (6, "b"), (7, "c")]
    inputs = spark.createDataFrame(rows, "ord long, url_key string")
    key = lambda k: spark.createDataFrame([(k,)], "url_key string")
    got = lambda n: [r.outcome for r in admission.admit(inputs, key("q"), key("h"), limit=n).orderBy("ord").collect()]
    assert got(0) == ["invalid", "handled", "duplicate", "limited", "limited", "limited", "limited", "limited"]
    assert got(1)[3:] == ["admitted", "duplicate", "limited", "limited", "limited"]
    assert got(None)[3:] == ["admitted", "duplicate", "admitted", "duplicate", "admitted"]
    counts = admission.admission_counts(admission.admit(inputs, key("q"), key("h"), limit=0)).first()
    assert (counts.input_count, counts.duplicate_count, counts.handled_count, counts.invalid_count, counts.skipped_count) == (8, 1, 1, 1, 8)


def test_quotas(spark):
    q = lambda n, most: [r.quota for r in admission.quotas(spark.range(n).select(F.col("id").alias("idx")), most).orderBy("idx").collect()]
    assert q(3, 10) == [4, 3, 3] and q(4, 3) == [1, 1, 1, 0]


def test_score_is_floor_of_weighted_mean(spark):
    def score(*parts):
        named = dict(zip(eligibility.WEIGHTS, map(F.lit, parts), strict=True))
        return spark.range(1).select(eligibility.weighted_score(named).alias("s")).first().s

    assert score(100, 60, 80, 50) == 78 and score(100, 100, 70, 50) == 87
    assert [r.b for r in spark.createDataFrame([(70,), (40,), (20,), (19,)], "s int").select(eligibility.bucket(F.col("s")).alias("b")).collect()] == ["apply", "consider", "low_priority", "skip"]


GATE = "id int, deadline string, graduation_years array<string>, graduation_start string, graduation_end string, graduation_requirement string, education_levels array<string>, locations array<string>, p_graduation string, p_education string, p_excluded array<string>"


def test_gate_rules_in_order(spark):
    base = dict(deadline="2030-01-01", years=["2027"], start=None, end=None, req="graduating in 2027", edu=["bachelor"], loc=["上海"], pg="2027-06", pe="硕士", px=["北京"])
    cases = [
        {}, {"deadline": "2020-01-01", "edu": ["doctorate"]}, {"start": "2025-09", "end": "2026-06"}, {"years": ["2026"]}, {"years": ["2026"], "req": None},
        {"edu": ["doctorate"]}, {"loc": ["北京"]}, {"loc": ["北京", "上海"]}, {"deadline": None, "years": [], "req": "cohort", "edu": [], "loc": []}, {"deadline": "soon"},
    ]
    rows = [(k, *(base | c).values()) for k, c in enumerate(cases)]
    got = [(r.flag, r.risk_flags) for r in eligibility.basic_gate(spark.createDataFrame(rows, GATE), F.lit("2026-01-01").cast("date")).orderBy("id").collect()]
    assert [f for f, _ in got] == [None, "expired_deadline", "graduation_window_mismatch", "graduation_year_mismatch", None, "education_level_mismatch", "excluded_location", None, None, None]
    assert got[4][1] == ["ambiguous_graduation_year_mismatch: candidate 2027"]
    assert got[8][1] == ["deadline_unknown", "graduation_requirement_unknown", "education_requirement_unknown", "location_unknown"]
    assert got[9][1] == ["invalid_deadline_format: soon"]


def test_best_of_equals_is_stable(spark):
    rows = spark.createDataFrame([(0, "k", False, 3), (1, "k", True, 1), (2, "k", True, 1), (3, "m", False, 0)], "ord int, key string, official boolean, n int")
    got = {r.ord: (r.best, r.position) for r in records.best_of_equals(rows, "key", "ord", F.col("official"), F.col("n")).collect()}
    assert got == {0: (False, 0), 1: (True, 0), 2: (False, 0), 3: (True, 3)}


def test_validation_and_keys(spark):
    rows = spark.createDataFrame([("T", "https://a.b/c", "2026-12-31"), (" ", "javascript:x", "2026/12/31"), ("T", "file:///x", None), ("T", None, "")], "title string, url string, deadline string")
    got = [r.x for r in rows.select(records.validation_reasons(F.col("title"), F.col("url"), F.col("deadline")).alias("x")).collect()]
    assert got[0] == [] and len(got[1]) == 3 and got[2] == [] and got[3] == []
    key = spark.createDataFrame([("Ünit", "Dev", ["上海"], None, ""), ("a", "b", [], None, "http://X.y/z")], "c string, t string, l array<string>, a string, s string")
    assert [r.k for r in key.select(records.dedup_key(*map(F.col, "ctlas")).alias("k")).collect()] == ["fallback|nit|dev|上海", "url|http x y z"]


def test_upsert_keeps_what_users_set(spark):
    old = spark.createDataFrame([(1, "a", 1, "seen"), (5, "b", 1, "sent")], "id long, key string, fact int, status string")
    new = spark.createDataFrame([("b", 9, "x"), ("d", 4, "x"), ("c", 3, "x")], "key string, fact int, status string")
    got = [tuple(r) for r in records.upsert(old, new, "key", ["status"]).orderBy("id").select("id", "key", "fact", "status", "action").collect()]
    assert got == [(1, "a", 1, "seen", "unchanged"), (5, "b", 9, "sent", "updated"), (6, "c", 3, "x", "inserted"), (7, "d", 4, "x", "inserted")]
    with pytest.raises(ValueError):
        records.set_status(old, 1, "nope", "")


def test_cleaning_keeps_prose(spark):
    body = "\n".join(["Home", "Jobs", "About", "Privacy Policy", "We look for someone who builds things well.", "Duties: build", "Footer link", "Footer link", "https://a.b https://c.d", "More prose stands here, and it ends with a stop."])
    judged = pages.clean_lines(spark.createDataFrame([(1, body), (2, ""), (3, None)], "page_id int, text string"))
    got = {r.page_id: r.text for r in pages.cleaned_text(judged).collect()}
    assert got[1].split("\n") == ["We look for someone who builds things well.", "Duties: build", "More prose stands here, and it ends with a stop."]


def test_routes(spark):
    rows = [(1, "https://a.b", "Login", "x" * 400, None, 200, None, None), (2, "https://a.b", "T", "x" * 400, None, 500, None, None), (3, "https://a.b", "T", "short", "<meta name='description' content='y'>", 200, None, None), (4, "https://a.b", "T", "x" * 400, None, 200, None, None), (5, "https://a.b", "T", "x" * 400, None, 200, "https://a.b/e?error=1", None)]
    got = {r.id: (r.status, r.codes) for r in pages.route(spark.createDataFrame(rows, "id int, url string, title string, text string, html string, status_code int, final_url string, fetch_error string")).collect()}
    assert got[1] == ("rejected", ["auth_wall"]) and got[2] == ("rejected", ["bad_status_code"]) and got[4] == ("readable", []) and got[5][1] == ["redirected_to_error_page"]
    assert got[3] == ("recoverable", ["insufficient_visible_text", "recoverable_metadata_present", "needs_manual_review"])


def test_links_by_kind(spark):
    links = [("https://a.b/about", "About"), ("https://a.b/jobs/1", "Dev"), ("https://a.b/x.pdf", "apply form"), ("https://a.b/go", "Apply now"), ("https://a.b/jobs/1", "again")]
    row = spark.createDataFrame([(1, "Please apply at\nhttps://t.u/apply.\nthanks", links)], "page_id int, text string, links array<struct<href:string,text:string>>")
    assert [(r.kind, r.url) for r in pages.important_links(row).orderBy("place").collect()] == [("apply", "https://a.b/go"), ("apply", "https://t.u/apply"), ("job_detail_candidate", "https://a.b/jobs/1"), ("attachment", "https://a.b/x.pdf")]


def test_inspection(spark):
    rows = spark.createDataFrame([(" ",), ("<div id='root'></div>",), ("plain\x00",), ("<p>Verify you are human</p>",)], "h string")
    got = [r.x for r in rows.select(pages.inspection(F.col("h"), F.lit(200), F.lit("text/html")).alias("x")).collect()]
    assert got == [["empty_page"], ["javascript_shell"], ["binary_or_mojibake"], ["access_interstitial"]]


def test_extraction_rules(spark):
    jobs = [("many", f"t{k}", None, None, True, None) for k in range(10)] + [("two", "t", None, None, True, "u"), ("two", "t", None, None, True, "u"), ("good", "t", "d", "r", True, "u")]
    rows = spark.createDataFrame(jobs, "page string, title string, description string, requirements string, has_location boolean, apply_url string")
    asked = spark.createDataFrame([("many", False), ("two", False), ("good", False), ("none", True)], "page string, has_links boolean")
    got = {r.page: (r.rule, r.priority, r.duplicate_title_count) for r in followups.extraction_triage(asked, rows, "page").collect()}
    assert got == {"many": ("many_sparse", 80, 0), "two": ("sparse_with_links", 80, 1), "good": (None, None, 0), "none": ("no_records", 60, 0)}


def test_published_scores(spark):
    """Totals that published examples show."""
    base = dict(executable=0.0, fill=0.0, deficit=0, mean_priority=0.0, frontier_executable=0, frontier_high=0, matches=1, refill_left=2, yield_rate=0.0, last_action="none", last_status="ok")
    cases = [("acquire_page", dict(executable=5.0, fill=1.0), 6.0), ("acquire_page", dict(executable=12.0, fill=1.0), 11.0), ("match_analysis", dict(executable=3.0, fill=1.0, deficit=5), 6.5), ("build_search_plan", dict(deficit=5), 3.25), ("stop", {}, 0.0)]
    rows = [(a, *(base | c).values()) for a, c, _ in cases]
    names = "action string, executable double, fill double, deficit int, mean_priority double, frontier_executable int, frontier_high int, matches int, refill_left int, yield_rate double, last_action string, last_status string"
    assert [r.total for r in features.score_actions(spark.createDataFrame(rows, names)).collect()] == [t for _, _, t in cases]


def test_search_plan_turns(spark):
    p = spark.createDataFrame([(1, 1, "2026-10", ["Dev", "Ops"], ["Perth", "Sydney"], [])], "profile int, round int, graduation string, roles array<string>, places array<string>, kinds array<string>")
    none = p.where("false").select("profile", F.lit("").alias("query"))
    first = [r.query for r in search_plan.search_queries(p, none).orderBy("idx").collect()]
    assert first == ['"Dev" 2027校招 Sydney employer job description requirements', '"Ops" 2027校招 Perth employer graduate program']
    done = spark.createDataFrame([(1, q.upper()) for q in first], "profile int, query string")
    assert [r.query for r in search_plan.search_queries(p, done).collect()] == ['"Ops" 2027校招 Sydney graduate program']


CHAIN = {"acquire_page": ("acquisition_queue", "acquired_pages"), "analyze_page": ("acquired_pages", "job_detail_pages"), "job_extraction": ("job_detail_pages", "prepared_jobs"), "job_understanding": ("prepared_jobs", "understanding_records"), "match_analysis": ("understanding_records", "match_assessments")}


def chained():
    """Stages that hand addresses on, and what each still has to do."""

    def stage(source, target):
        def f(r):
            out = {target: r.tables[source].select("url")}
            return out | {source: r.tables[source].where("false")} if source == "acquisition_queue" else out

        return f

    def pending(r):
        left = {}
        for action, (source, target) in CHAIN.items():
            if source in r.tables:
                todo = r.tables[source] if target not in r.tables else r.tables[source].join(r.tables[target], "url", "left_anti")
                left[action] = todo.count()
        return left

    return {a: stage(*x) for a, x in CHAIN.items()}, pending


def started(spark, path):
    return loop.Run(spark, str(path), {"acquisition_queue": spark.createDataFrame([("a",), ("b",)], "url string")}, {"has_plan": True, "search_rounds": 3})


def test_loop_runs_to_a_stop(spark, tmp_path):
    """Two sources go through all stages; the run ends by itself and keeps its history."""
    ended = []
    done = loop.drive(started(spark, tmp_path), *chained(), on_stop=lambda r: ended.append(r.facts["stop_reason"]))
    assert [t["action"] for t in done.trace] == [*CHAIN, "stop"] and done.tables["match_assessments"].count() == 2 and len(ended) == 1
    assert loop.history(spark, [{"step": t["step"], "action": t["action"]} for t in done.trace]).first().action == "stop"
    assert [r.action for r in loop.history(spark, str(tmp_path)).collect()] == ["stop", *reversed(CHAIN), "start"]
    assert loop.resume(spark, str(tmp_path), *chained()).facts["stop_reason"] == ended[0]


def test_loop_resumes_and_replays(spark, tmp_path):
    """A paused run goes on where it stood; a replayed step goes to a folder of its own; a failed stage is a step."""
    stages, pending = chained()
    first = loop.drive(started(spark, tmp_path / "run"), stages, pending, pause_after=True)
    assert [t["action"] for t in first.trace] == ["acquire_page"] and first.step == 1
    rest = loop.resume(spark, str(tmp_path / "run"), stages, pending)
    assert [t["action"] for t in rest.trace] == [*list(CHAIN)[1:], "stop"] and rest.tables["match_assessments"].count() == 2
    again = loop.replay(spark, str(tmp_path / "run"), 0, str(tmp_path / "branch"), stages, pending)
    assert [t["action"] for t in again.trace] == ["analyze_page"] and set(again.tables) == {"acquisition_queue", "acquired_pages", "job_detail_pages"}
    assert loop.detail(spark, str(tmp_path / "run"), 2)["action"] == "job_extraction" and loop.steps(spark, str(tmp_path / "branch")).count() == 1
    with pytest.raises(KeyError):
        loop.resume(spark, str(tmp_path / "none"), stages, pending)
    with pytest.raises(KeyError):
        loop.detail(spark, str(tmp_path / "run"), 99)
    limited = started(spark, tmp_path / "limited")
    limited.limits["max_steps"] = 1
    assert loop.drive(limited, {}, pending).facts["stop_reason"] == "max_steps" and "KeyError" in limited.facts["errors"][0]


def test_providers_isolate_errors(spark):
    rows = spark.createDataFrame([(1, "good"), (2, "bad"), (3, "half")], "id long, prompt string")

    def make():
        def ask(prompt):
            if prompt.startswith("bad"):
                raise OSError("down")
            return '{"title": "x"}' if prompt.startswith("good") or "valid JSON" in prompt else "nonsense"

        return ask

    got = {r.id: (r.value and r.value.title, r.error) for r in providers.parsed(providers.asked(rows, "id", make), "title string").collect()}
    assert got == {1: ("x", None), 2: (None, "OSError: down"), 3: ("x", None)}
    assert {r.id: r.error for r in providers.recorded(rows, spark.createDataFrame([(1, "{}")], "id long, answer string"), "id").collect()}[2] == "no recorded answer"


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.json").write_text('[{"url": "u", "ord": 1}]', encoding="utf-8-sig")
    assert readers.json_artifact(spark, str(tmp_path / "a.json"), "ord long, url string").first().url == "u"
    assert readers.optional_artifact(spark, [str(tmp_path / "none.json")], "ord long").count() == 0
    (tmp_path / "page.html").write_bytes("<p>é</p>".encode())
    got = readers.acquired(readers.files(spark, str(tmp_path / "page.html")).withColumns({"status_code": F.lit(200), "content_type": F.lit("text/html"), "content_encoding": F.lit("")})).first()
    assert (got.html, got.kind, got.flaws, got.browser_fallback) == ("<p>é</p>", "html", [], False)
    with pytest.raises(ValueError):
        readers.profile(spark, {"preferred_locations": ["A"], "excluded_locations": ["a"]})
    good, bad = sinks.rejected(spark.createDataFrame([("c", "s"), ("", "s")], "company_name string, source_name string"))
    assert (good.count(), bad.count()) == (1, 1)
    sinks.write_csv(spark.createDataFrame([(1, ["x", "y"])], "id int, places array<string>"), str(tmp_path / "csv"))
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).first().places == "x,y"


def test_streamed_backlog_works_once(spark, tmp_path):
    def put(name, ids):
        spark.createDataFrame([(i,) for i in ids], "key long").coalesce(1).write.parquet(f"{tmp_path}/in/{name}")

    def turn():
        stream = spark.readStream.schema("key long").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        backlog.work_off(stream, "key", f"{tmp_path}/out", lambda b: b.withColumn("done", F.lit(True)), f"{tmp_path}/ck").awaitTermination(60)
        return sorted(r.key for r in spark.read.parquet(f"{tmp_path}/out/results").collect())

    put("a", [1, 2, 2])
    assert turn() == [1, 2]
    put("b", [2, 3])
    assert turn() == [1, 2, 3]


def test_availability_reasons(spark):
    given = {"stopped": False, "has_plan": False, "has_profile": False, "last_search": "error"}
    cols = [c.strip().split(" ") for c in availability.COLUMNS.split(",")]
    row = spark.createDataFrame([(0, *(given.get(n, 0) for n, _ in cols))], "state int, " + availability.COLUMNS)
    got = {r.action: r.reasons for r in availability.action_table(row).collect()}
    assert got["build_search_plan"] == ["profile is required by build_search_plan", "previous Tavily search failed"]
    assert got["acquire_page"] == ["acquisition_queue is empty"] and got["stop"] == []


def test_fetching_retries_and_falls_back(spark):
    """Errors stay with their row; a page that a browser should try takes its answer, or both errors."""

    def make():
        seen = {}

        def get(url):
            seen[url] = seen.get(url, 0) + 1
            if url == "down" or (url == "late" and seen[url] < 2):
                raise OSError("no answer")
            return b"x" * (50 if url == "big" else 5), 200, url + "/", {"Content-Type": "text/html"}

        return get

    urls = spark.createDataFrame([("down",), ("late",), ("big",), ("fine",)], "url string").coalesce(1)
    got = {r.url: r for r in readers.fetched(urls, make, retries=1, most_bytes=10, pause=0).collect()}
    assert (got["late"].attempts, got["late"].fetch_error, bytes(got["fine"].body), got["fine"].final_url) == (2, None, b"xxxxx", "fine/")
    assert got["down"].fetch_error == "OSError: no answer" and got["big"].fetch_error.endswith("response exceeds limit: 50 bytes")
    first = readers.fetched(urls, make, retries=0, most_bytes=10, pause=0).withColumn("browser_fallback", F.col("fetch_error").isNotNull())
    both = {r.url: r for r in readers.with_fallback(first, readers.fetched(urls, make, retries=1, pause=0, browser=True)).collect()}
    assert (both["big"].fetch_method, both["big"].fetch_error, both["fine"].fetch_method) == ("browser", None, "http")
    assert both["down"].fetch_error == "OSError: no answer; browser: OSError: no answer"


def test_configuration_and_earlier_artifacts(spark, tmp_path):
    """A private file goes before the example; sources must say that they are enabled; a report goes before the list."""
    (tmp_path / "sources.example.yaml").write_text("sources: []")
    assert readers.config_file(str(tmp_path), "sources") == ({"sources": []}, True) and readers.configured_sources(spark, str(tmp_path)).count() == 0
    (tmp_path / "sources.yaml").write_text("sources:\n- {url: u, enabled: true, official: true, type: portal}\n- {url: v, name: n}\n")
    row = readers.configured_sources(spark, str(tmp_path)).collect()
    assert [(r.url, r.title, r.relevance_score, r.is_official, r.reason) for r in row] == [("u", "u", 100, True, "Manually configured source: portal")]
    (tmp_path / "p.md").write_text("Read.", encoding="utf-8-sig")
    assert readers.prompt_text(str(tmp_path), "p") == "Read."
    assert readers.prior_followups(spark, str(tmp_path)).count() == 0
    (tmp_path / "pending_followups.json").write_text('[{"url": "a"}, {"url": "b"}]')
    assert readers.prior_followups(spark, str(tmp_path)).count() == 2
    (tmp_path / "page_acquisition_report.json").write_text('{"pending_followups": [{"url": "c", "priority": 5}], "other": 1}')
    assert [(r.url, r.priority) for r in readers.prior_followups(spark, str(tmp_path)).collect()] == [("c", 5)]
    (tmp_path / "page_acquisition_report.json").write_text("{broken")
    assert readers.prior_followups(spark, str(tmp_path)).count() == 0
    assert [r.url for r in readers.manual_sources(spark, [{"url": "x"}, {"url": "y"}]).orderBy("ord").collect()] == ["x", "y"]


def test_tools_leave_a_trace(spark):
    kit = tools.kit(spark, "mock", boom=lambda: 1 / 0)
    assert kit.run("web_search", "q").count() == 3
    with pytest.raises(ZeroDivisionError):
        kit.run("boom")
    with pytest.raises(ValueError):
        kit.add("boom", len)
    got = kit.events(spark).orderBy("ord").collect()
    assert [(r.tool, r.error) for r in got] == [("web_search", None), ("boom", "division by zero")] and got[0].result.startswith("table[ord, url")


def test_counted_upsert_and_sinks(spark, tmp_path):
    old = spark.createDataFrame([(7, "k1", "c", "s", "感兴趣")], "id long, deduplication_key string, company_name string, source_name string, status string")
    new = spark.createDataFrame([("k1", "d", "s", "未查看"), ("k2", "c", "s", "未查看"), ("k3", None, None, "未查看")], "deduplication_key string, company_name string, source_name string, status string")
    _, refused, _ = records.upsert_counted(old, new, "deduplication_key", ["status"], ["company_name", "source_name"])
    assert [(r.deduplication_key, r.reason) for r in refused.collect()] == [("k3", "NOT NULL constraint failed: company_name, source_name")]
    assert sinks.persist_jobs(old, new, str(tmp_path / "jobs"), 1) == {"inserted_count": 1, "updated_count": 1, "failed_count": 1}
    kept = {r.deduplication_key: (r.id, r.company_name, r.status) for r in spark.read.parquet(str(tmp_path / "jobs/version=1")).collect()}
    assert kept == {"k1": (7, "d", "感兴趣"), "k2": (8, "c", "未查看")}
    sinks.csv_for_download(old, str(tmp_path / "g.csv"))
    assert (tmp_path / "g.csv").read_bytes().startswith(b"\xef\xbb\xbfdeduplication_key")
    with pytest.raises(ValueError):
        sinks.csv_for_download(old.union(old), str(tmp_path / "g.csv"), most=1)


def test_prompts_and_traces(spark):
    row = spark.createDataFrame([(1, "T", "text", False), (2, "U", "more", True)], "page_id long, title string, visible_text string, hard_reject boolean")
    jobs = row.select(F.col("page_id").cast("string").alias("deduplication_key"), "title", F.lit("d").alias("description"), F.lit(None).cast("string").alias("requirements"), F.lit("campus").alias("recruitment_type"), "hard_reject")
    asked = stages.understanding_requests(jobs, " Do it. ").collect()
    assert len(asked) == 1 and asked[0].prompt.startswith("Do it.\n\nReturn ONLY valid JSON.") and asked[0].prompt.endswith('Input:\n{"job":{"title":"T","description":"d","requirements":null,"recruitment_type":"campus"}}')
    batch = stages.extraction_requests(row.withColumn("batch", F.lit(0)), "Extract.").first().prompt
    assert batch.endswith('{"pages":[{"page_id":1,"title":"T","visible_text":"text"},{"page_id":2,"title":"U","visible_text":"more"}]}')
    links = row.withColumn("important_links", F.array().cast("array<string>"))
    assert '"allowed_page_types":["job_detail",' in stages.classification_requests(links, "Classify.").first().prompt
    trace = pages.analysis_trace(row.withColumns({"url": F.lit("u"), "html": F.lit("<p>text</p>"), "removed": F.lit(2)}), "html", "removed").first()
    assert (trace.original_chars, trace.cleaned_chars, trace.removed_line_count, trace.classification_truncated) == (11, 4, 2, False)
    steps = spark.createDataFrame([(1, 0, "a"), (2, 1, "b"), (3, 1, "c")], "step int, search_round int, action string")
    got = {r.search_round: r.entry and r.entry.action for r in loop.trace_entry(steps, spark.createDataFrame([(1,), (5,)], "search_round int")).collect()}
    assert got == {1: "c", 5: None}
