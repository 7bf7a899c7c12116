"""Artifacts, acquisition in two passes, answers asked again, bounded lists of errors, catalogues of places."""

import json

import pytest
from pyspark.sql import functions as F

from sievewright.functions import locations, urls
from sievewright.operators import features, records, stages
from sievewright.sources import artifacts, readers, web


def test_artifact_is_one_file_that_people_read(spark, tmp_path):
    path = tmp_path / "deep" / "jobs.json"
    rows = spark.createDataFrame([(1, "é\n\"x\"", ["a", "b"], {"k": 1}, None), (2, None, [], None, (3, "2020-01-02"))], "id long, text string, l array<string>, m map<string,int>, s struct<n:int,d:string>")
    artifacts.write_artifact(rows.withColumns({"day": F.lit("2020-01-02").cast("date"), "money": F.lit("1.50").cast("decimal(5,2)")}).coalesce(1), str(path))
    text = path.read_text(encoding="utf-8")
    assert json.loads(text) == [
        {"id": 1, "text": "é\n\"x\"", "l": ["a", "b"], "m": {"k": 1}, "s": None, "day": "2020-01-02", "money": 1.5},
        {"id": 2, "text": None, "l": [], "m": None, "s": {"n": 3, "d": "2020-01-02"}, "day": "2020-01-02", "money": 1.5},
    ]
    assert text.startswith("[\n  {\n    \"id\": 1,\n") and "é" in text and text.endswith("}\n]\n")
    assert [r.text for r in readers.json_artifact(spark, str(path), "id long, text string").orderBy("id").collect()] == ["é\n\"x\"", None]


def test_artifact_of_many_tasks(spark, tmp_path):
    """Rows keep the order of their partitions; a write that fails leaves the earlier artifact and no parts behind."""
    path = tmp_path / "a.json"
    artifacts.write_artifact(spark.range(0, 1000, 1, 7), str(path))
    assert [r["id"] for r in json.loads(path.read_text())] == list(range(1000)) and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    with pytest.raises(Exception, match="write_json"):
        artifacts.write_artifact(spark.range(50), str(path), most_bytes=100)
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_artifact(spark.range(5), str(path), overwrite=False)
    with pytest.raises(Exception, match="(?i)zero"):
        artifacts.write_artifact(spark.range(5).select((1 / (F.col("id") - 3)).alias("x")), str(path))
    assert len(json.loads(path.read_text())) == 1000 and [p.name for p in tmp_path.iterdir()] == ["a.json"]
    artifacts.write_artifact(spark.range(0), str(path))
    assert json.loads(path.read_text()) == []


def test_artifact_in_files(spark, tmp_path):
    """Rows of any number: files of a bounded size, each an array, and a list of those that count."""
    path = tmp_path / "deep" / "a"
    files = lambda: sorted(p.name for p in path.iterdir())
    rows = spark.range(0, 1000, 1, 7).withColumn("text", F.when(F.col("id") % 5 > 0, F.concat(F.lit("é\n],"), F.col("id"))))
    artifacts.write_parts(rows, str(path), part_bytes=2000)
    listed = json.loads((path / "files.json").read_text())
    assert listed["rows"] == 1000 and files() == sorted([*listed["files"], "files.json"]) and all((path / n).stat().st_size < 2100 for n in listed["files"])
    assert [r["id"] for n in listed["files"] for r in json.loads((path / n).read_text())] == list(range(1000))
    (path / "000000-000000-9-left.json").write_text("[{")  # of an attempt that did not count
    back = lambda: readers.json_parts(spark, str(path), "id long, text string")
    assert sorted(map(tuple, back().collect())) == sorted(map(tuple, rows.collect()), key=lambda r: r[0])
    with pytest.raises(Exception, match="(?i)exists"):
        artifacts.write_parts(spark.range(5), str(path), overwrite=False)
    with pytest.raises(Exception, match="(?i)zero"):
        artifacts.write_parts(spark.range(5).select((1 / (F.col("id") - 3)).alias("x")), str(path))
    assert back().count() == 1000
    artifacts.write_parts(spark.range(3), str(path), part_bytes=1)
    assert sorted(r.id for r in back().collect()) == [0, 1, 2] and len(files()) == 4
    (path / json.loads((path / "files.json").read_text())["files"][0]).write_text("[{")
    with pytest.raises(Exception, match="(?i)malformed"):
        back().collect()
    artifacts.write_parts(spark.range(0), str(path))
    assert back().count() == 0 and files() == ["files.json"]


def test_artifact_beyond_one_file(spark, tmp_path, monkeypatch):
    """The round trip has no limit of bytes, and null stays null."""
    from sievewright.plans import catalogue

    spark.range(40).select(F.col("id").alias("doc_id"), F.repeat(F.lit("word "), 20).alias("text"), F.when(F.col("id") > 3, "en").alias("lang"), F.lit("s").alias("source"), F.lit(100).cast("long").alias("n_chars")).write.parquet(str(tmp_path / "documents.parquet"))
    monkeypatch.setattr(artifacts.write_artifact, "__defaults__", (True, 1000))
    got = catalogue.queries()["artifact_round_trip"](spark, str(tmp_path)).orderBy("doc_id").collect()
    assert [r["doc_id"] for r in got] == list(range(40)) and [r["keys"] for r in got] == [None] * 4 + ["en/s"] * 36


def responses(rows, told):
    """``told``: address to (body, error)."""
    d = rows.join(rows.sparkSession.createDataFrame([(u, None if b is None else b.encode(), e) for u, (b, e) in told.items()], "url string, body binary, fetch_error string"), "url")
    return d.select("url", "body", F.when(F.col("fetch_error").isNull(), 200).alias("status_code"), F.col("url").alias("final_url"), F.lit("text/html").alias("content_type"), F.lit("").alias("content_encoding"), F.lit(1).alias("attempts"), F.lit("http").alias("fetch_method"), "fetch_error")


def test_only_flawed_pages_are_rendered(spark):
    good = "<html><title>Fine</title><p>Text</p></html>"
    first = {"https://a/fine": (good, None), "https://a/shell": ("<div id='root'></div>", None), "https://a/down": (None, "E: down"), "https://a/dead": (None, "E: dead"), "https://a/empty": (" ", None)}
    asked = []

    def render(rows):
        asked.extend(sorted(r.url for r in rows.collect()))
        return responses(rows, {"https://a/shell": (good, None), "https://a/down": (good, None), "https://a/dead": (None, "E: gone"), "https://a/empty": ("", None)}).withColumn("fetch_method", F.lit("browser"))

    sources = spark.createDataFrame([(u,) for u in [*first, "https://a/fine"]], "url string")
    pages, counts = readers.acquire(sources, lambda rows: responses(rows, first), render)
    got = {r.url: r for r in pages.collect()}
    assert asked == ["https://a/dead", "https://a/down", "https://a/empty", "https://a/shell"] and len(got) == 5
    assert {u: (r.title, r.fetch_method, r.fetch_error) for u, r in got.items()} == {
        "https://a/fine": ("Fine", "http", None), "https://a/shell": ("Fine", "browser", None), "https://a/down": ("Fine", "browser", None), "https://a/dead": (None, "http", "E: dead; browser: E: gone"), "https://a/empty": (None, "browser", None),
    }
    assert counts.first().asDict() == {"sources": 5, "rendered": 3, "failed": 1, "clean": 3, "flawed": 1}
    bare, counts = readers.acquire(sources, lambda rows: responses(rows, first))
    assert counts.first().asDict() == {"sources": 5, "rendered": 0, "failed": 2, "clean": 1, "flawed": 2} and bare.count() == 5


PAGES = "batch long, page_id string, ord long, url string, source_name string, source_company_name string, company_type string, source_location string, is_official boolean, title string, visible_text string, important_links array<struct<url:string,text:string,kind:string>>"


def test_wrong_answers_are_asked_again(spark):
    """A provider that is wrong once loses no page; one that always is loses its own batch only, page by page."""
    rows = [(b, f"p{b}{k}", 10 * b + k, f"https://a/{b}{k}", "s", None, None, None, True, "t", "v", []) for b in range(3) for k in range(2)]
    seen = []

    def ask(requests):
        told = []
        for r in requests.collect():
            seen.append((r.attempt, r.batch, stages.AGAIN in r.prompt))
            ids = [f"p{r.batch}{k}" for k in range(2)]
            wrong = {(1, 1): [ids[0], ids[0], ids[1]], (1, 2): None, (2, 2): ids[:1], (3, 2): [*ids, "other"]}.get((r.attempt, r.batch), ids)
            told.append((r.batch, json.dumps([{"page_id": i, "page_context": {}, "jobs": [{"title": i}]} for i in wrong]) if wrong else None, None if wrong else "TimeoutError: late"))
        return spark.createDataFrame(told, "batch long, answer string, error string")

    raw, errors, report = stages.extracted_with_repair(spark.createDataFrame(rows, PAGES), ask, "Do.", attempts=3, order="ord")
    assert sorted(r.title for r in raw.collect()) == ["p00", "p01", "p10", "p11"]
    assert sorted((r.page_id, r.reason) for r in errors.collect()) == [(f"p2{k}", "AI extraction page_id values do not match the input pages.") for k in range(2)]
    assert sorted(map(tuple, report.collect())) == [(1, 3, 1), (2, 2, 1), (3, 1, 0)]
    assert sorted(seen) == [(1, 0, False), (1, 1, False), (1, 2, False), (2, 1, True), (2, 2, True), (3, 2, True)]
    with pytest.raises(ValueError):
        stages.extracted_with_repair(spark.createDataFrame(rows, PAGES), ask, "Do.", attempts=0)
    raw, errors, report = stages.extracted_with_repair(spark.createDataFrame([], PAGES), ask, "Do.")
    assert raw.count() == errors.count() == 0 and [tuple(r) for r in report.collect()] == [(1, 0, 0)]


def test_single_pages(spark):
    pages = spark.createDataFrame([(0, "p", 7, "https://a/1", "s", None, None, None, True, "t", "v", []), (0, "q", 8, "https://a/2", "s", None, None, None, True, "t", "v", []), (0, "r", 9, "https://a/3", "s", None, None, None, True, "t", "v", [])], PAGES)
    answers = spark.createDataFrame([("https://a/1", '{"page_context": {"deadline": "2030-01-01"}, "jobs": [{"title": "x"}, {"title": "y"}]}', None), ("https://a/2", '{"page_id": "https://a/1", "page_context": {}, "jobs": []}', None)], "url string, answer string, error string")
    raw, errors = stages.extracted_singly(pages, answers)
    assert sorted((r.page_url, r.ord, r.title, r.deadline, r.source_url) for r in raw.collect()) == [("https://a/1", 7, t, "2030-01-01", "https://a/1") for t in "xy"]
    assert {r.url: r.reason for r in errors.collect()} == {"https://a/2": "answer does not fit its schema", "https://a/3": "no recorded answer"}


def test_first_errors_of_a_stage(spark):
    rows = spark.range(0, 400, 1, 5).select(F.when(F.col("id") < 400, "s").alias("stage"), "id", F.when(F.col("id") % 2 == 1, F.concat(F.lit("e"), (F.col("id") % 3).cast("string"))).alias("error")).withColumn("ok", F.col("error").isNull())
    got = features.stage_report(rows, ["stage"], "ok", "error", "id", 3).first()
    assert (got.total, got.succeeded, got.failed) == (400, 200, 200) and sum(e.n for e in got.errors) == 200
    assert [(e.n, e.at, e.error) for e in got.first_errors] == [(1, 1, "e1"), (2, 3, "e0"), (3, 5, "e2")]
    plan = features.stage_report(rows, ["stage"], "ok", "error", "id", 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") >= 2  # before and after the exchange
    clean = features.stage_report(rows.where("ok"), ["stage"], "ok", "error", "id", 3).first()
    assert (clean.failed, clean.first_errors) == (0, None)


def test_frontier_and_preparation_of_nothing(spark):
    shape = "pending_kind string, suggested_next_action string, stage string, priority int, is_official boolean, links array<string>, page_type string, confidence string, executable boolean"
    got = features.frontier_features(spark.createDataFrame([], shape)).first()
    assert (got.pending_count, got.usable_link_count, got.counts_by_stage, got.mean_priority) == (0, 0, {}, None)
    assert tuple(records.preparation_counts(spark.createDataFrame([], "reasons array<string>, k string"), "reasons", "k").first()) == (0, 0, 0, 0, 0)


def test_catalogue_file(spark, tmp_path):
    entries = ["上海市", "台湾省", {"name": "Ohio Province", "pinyin": "oh", "children": [{"name": "Akron City", "alias": ["A", " "]}, {"pinyin": "none"}, "text"]}, {"city": "Lone City", "aliases": "L", "en": "lone"}, {"name": "西藏自治区", "children": [{"name": "x"}]}, 5, None, {"name": " "}, {"children": []}]
    for name, whole in (("list", entries), ("cities", {"cities": entries}), ("data", {"data": entries})):
        (tmp_path / f"{name}.json").write_text(json.dumps(whole, ensure_ascii=False), encoding="utf-8-sig")
        got = [(r.city, r.province, r.aliases) for r in locations.catalog_file(spark, str(tmp_path / f"{name}.json")).orderBy("ord").collect()]
        assert got == [("上海", None, []), (None, "台湾", []), (None, "Ohio", ["oh"]), ("Akron", "Ohio", ["A"]), ("Lone", None, ["L", "lone"]), (None, "西藏自治区", [])]
    (tmp_path / "bad.json").write_text("{broken")
    assert locations.catalog_file(spark, str(tmp_path / "bad.json")).count() == 0


def test_names_of_sources(spark):
    rows = spark.createDataFrame([("https://A.b:8/c", None, "T"), ("https://a.b/c", "http://f.g/", "T"), ("file:///x/My%20job.v1.html", None, "T"), ("mock:abc", None, "T"), ("words", "", ""), ("//h/x", None, None)], "u string, f string, t string")
    got = [tuple(r) for r in rows.select(urls.source_of_followup(F.col("u")), urls.source_of_page(F.col("u"), F.col("f"), F.col("t")), urls.source_of_file(F.col("u"), F.col("f"), F.col("t"))).collect()]
    assert got == [("A.b:8", "A.b:8", "A.b:8"), ("a.b", "f.g", "f.g"), ("", "T", "My job.v1"), ("mock:abc", "T", "mock"), ("words", "words", "words"), ("//h/x", "h", "h")]


def test_search_as_a_source(spark, tmp_path):
    """A task per query with its share of the answers; blank and repeated queries are not asked; a provider that fails is a row."""
    answers = [("a", k, f"t{k}", f"https://a/{k}", "c", 0.5) for k in range(9, 0, -1)] + [("b", 1, None, "https://b/1", "c", None)]
    spark.createDataFrame(answers, "query string, rank long, title string, url string, content string, score double").write.parquet(str(tmp_path / "answers"))
    spec, where = "sievewright.sources.web:recorded_search", f"file://{tmp_path}/answers"
    found = web.search(spark, ["a", "b", " ", "a", "none"], spec, 8, answers=where)
    assert found.rdd.getNumPartitions() == 3
    assert [(r.ord, r.query, r.url, r.error) for r in found.orderBy("ord").collect()] == [(0, "a", "https://a/1", None), (1, "a", "https://a/2", None), (2, "a", "https://a/3", None), (1_000_000, "b", "https://b/1", None)]
    assert web.search(spark, [], spec, 8, answers=where).count() == 0
    assert [r.error for r in web.search(spark, ["a"], "sievewright.sources.web:missing", 8).collect()] == ["AttributeError: module 'sievewright.sources.web' has no attribute 'missing'"]


def test_pages_as_a_source(spark, tmp_path):
    """All addresses of a host are one task's; one without a response is a row with its error."""
    urls_ = [f"https://h{k % 4}.example/{k}" for k in range(12)]
    spark.createDataFrame([(u, u.encode(), 200, "text/html") for u in urls_[:11]], "url string, body binary, status_code int, content_type string").write.parquet(str(tmp_path / "pages"))
    got = web.fetch(spark, [*urls_, urls_[0]], "sievewright.sources.web:recorded_pages", 3, answers=f"file://{tmp_path}/pages").withColumn("task", F.spark_partition_id())
    rows = got.collect()
    assert sorted(r.url for r in rows) == sorted(urls_) and {r.url: r.error for r in rows if r.error} == {urls_[11]: "KeyError: 'no recorded response'"}
    assert all(bytes(r.body) == r.url.encode() and r.status_code == 200 for r in rows if not r.error)
    tasks = {}
    for r in rows:
        tasks.setdefault(r.host, set()).add(r.task)
    assert len(tasks) == 4 and all(len(t) == 1 for t in tasks.values()) and got.rdd.getNumPartitions() <= 3


def test_batches_are_bounded(spark):
    """Long texts come to Python workers in batches of about a megabyte, short ones by a thousand; smaller settings stay."""
    import pandas as pd

    from sievewright.session import BATCH, ready

    @F.pandas_udf("int")
    def together(x: pd.Series) -> pd.Series:
        return pd.Series([len(x)] * len(x))

    held = {k: spark.conf.get(k) for k in BATCH}
    try:
        for k in BATCH:
            spark.conf.unset(k)
        ready(spark)
        most = lambda n, size: spark.range(0, n, 1, 1).select(together(F.repeat(F.lit("x"), F.lit(size) + F.col("id").cast("int") % 2)).alias("n")).agg(F.max("n")).first()[0]
        assert most(200, 100_000) <= 12 and most(5000, 10) == 1000
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "50")
        assert ready(spark).conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "50"
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)
