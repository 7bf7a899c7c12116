import gzip
import zlib

from pyspark.sql import functions as F

from sievewright.functions import dates, education, locations, markup, text, urls
from sievewright.session import ready


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'string'}" for k, v in values.items()))
    return row.select(column.alias("x")).first()[0]


def test_address_identity():
    assert urls.identity("https://Careers.Example/job/1/?utm_source=test#top") == "https://careers.example/job/1"
    assert urls.identity("http://x.example:80/") == "http://x.example/"
    assert urls.identity("https://x.example:8443?b=1&gclid=2&empty=") == "https://x.example:8443/?b=1"
    assert urls.identity("http://x.example:port/") is None
    assert urls.identity("   ") is None and urls.identity(None) is None


def test_dates(spark):
    norm = lambda v: one(spark, dates.normalize_date_text(F.col("v")), v=v)
    assert [norm(v) for v in ("2026/09", "2027.06.30", "2026/12/31", "20260930", "2026-9-3", None)] == ["2026-09", "2027-06-30", "2026-12-31", "2026-09-30", "2026-9-3", ""]
    assert one(spark, dates.iso_date(F.col("v")), v="2026-9-3") is None
    assert one(spark, dates.graduation_years(F.col("v")), v=["2027届, 2026", "120271", "2026"]) == ["2026", "2027"]
    assert one(spark, dates.cohort_year(F.col("v")), v="2026-09") == 2027
    assert one(spark, dates.cohort_year(F.col("v")), v="2027-06") == 2027
    assert one(spark, dates.year_month(F.col("v")), v="2026") == 202606


def test_education(spark):
    assert one(spark, education.levels(F.col("v")), v=["本科", "本科及以上学历", "硕士及以上", "博士", "unknown"]) == ["bachelor", "master", "doctorate"]
    assert one(spark, education.levels(F.col("v")), v=["博士研究生"]) == ["master"]


def test_locations(spark):
    ready(spark)
    catalog = spark.createDataFrame([(0, "上海", "上海", []), (1, "北京", "北京", []), (2, "深圳", "广东", []), (3, None, "广东", [])], locations.CATALOG)
    rows = spark.createDataFrame([(1, ["上海； 北京 / 深圳"]), (2, ["广东省", "深圳市"]), (3, ["Berlin HQ", "Berlin"]), (4, [])], "id int, places array<string>")
    assert {r.id: r.places for r in locations.normalize(rows, "id", "places", catalog).collect()} == {1: ["上海", "北京", "深圳"], 2: ["深圳"], 3: ["Berlin"], 4: []}


def test_lines_and_items(spark):
    assert one(spark, text.lines(F.col("v")), v="a\r\nb\x0bc\n") == ["a", "b", "c"]
    assert one(spark, text.collapse(F.col("v")), v=" a　 b\t\n") == "a b"
    assert one(spark, text.split_items(F.col("v")), v="Python, python; Go\nGo ") == ["Python", "Go"]


def test_markup():
    page = markup.outline('<title>T &amp; t</title><script>x</script><p>One <a href="/a?b">two  </a></p><a href="">no</a>', "https://e.example/x/")
    assert page["title"] == "T & t" and page["links"] == [{"href": "https://e.example/a?b", "text": "two"}]
    assert page["text"].split("\n")[-2:] == ["two", "no"] and "x" not in page["text"].split("\n")
    long = "Build things. " * 40
    found = markup.recover(f'<script type="application/ld+json">{{"@type": "JobPosting", "title": "T", "description": "{long}"}}</script>')
    assert found["success"] and found["source"] == "json_ld"
    assert markup.recover("<meta name='description' content='short'>")["reasons"] == ["meta_description_insufficient: 5 chars"]


def test_decoding():
    raw = "职位描述".encode("gb18030")
    assert markup.decode(raw, "text/html", "")["text"] == "职位描述"
    assert markup.decode(gzip.compress("é".encode()), "text/html; charset=utf-8", "gzip")["text"] == "é"
    bare = zlib.compressobj(wbits=-15)
    assert markup.decode(bare.compress(b"ok") + bare.flush(), "", "deflate")["text"] == "ok"
    assert "unsupported" in markup.decode(b"x", "", "br")["error"]
    assert markup.decode(b"x", "charset=nothing", "")["error"].startswith("LookupError")


def test_loose_json():
    assert markup.loose_json('```json\n{"a": [1, 2}\n```') == '{"a":[1,2]}'
    assert markup.loose_json('{"a": {"b": "x}"') == '{"a":{"b":"x}"}}'
    assert markup.loose_json('{"a": 1, oops') is None
    assert markup.loose_json("text") is None and markup.loose_json(None) is None


def test_lines_keep_their_digits(spark):
    """Blanks at the ends of lines go, digits stay whatever the line's number."""
    from sievewright.operators import pages

    row = spark.createDataFrame([("T", "0 Role 0\n 1 year 1 \n2 12\napply at https://a.b/3")], "title string, text string")
    assert row.select(pages.excerpt(F.col("title"), F.col("text")).alias("x")).first().x == "T\n0 Role 0\n1 year 1\n2 12\napply at https://a.b/3"
    links = pages.important_links(row.select(F.lit(1).alias("page_id"), "text", F.array().cast("array<struct<href:string,text:string>>").alias("links"))).collect()
    assert [(r.url, r.label) for r in links] == [("https://a.b/3", "apply at https://a.b/3")]


def test_only_marked_pages_are_parsed_for_hidden_content(spark):
    """Pages without a mark come to what the parser would say of them, and are not sent to it."""
    from sievewright.operators import pages

    ready(spark)
    hidden = "x" * 400
    rows = [(1, f"<meta name='description' content='{hidden}'>"), (2, "<p>nothing hidden</p>"), (3, None), (4, '<script type="application/ld+json">{broken</script>'), (5, f'<script>window.__NEXT_DATA__ = {{"description": "{hidden}"}}</script>')]
    df = spark.createDataFrame(rows, "page_id long, html string")
    got = {r.page_id: r.recovered for r in pages.recovery(df).collect()}
    want = {r.page_id: r.r for r in df.select("page_id", markup.recovered("html").alias("r")).collect()}
    assert got == want and [got[k].success for k in range(1, 6)] == [True, False, False, False, True]
    plan = pages.recovery(df)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("ArrowEvalPython") == 1 and "Filter (size(" in plan.replace("(size(array_compact", "(size(")


def test_distinct_lists_of_levels_are_ranked_once(spark):
    """The same ranks whether lists are joined back or ranked row by row; null and empty lists stay what they are."""
    lists = [["本科及以上"], ["Master's degree", "none"], [], None, ["PhD", "doctorate"], ["本科及以上"]]
    rows = spark.createDataFrame(list(enumerate(lists)), "id int, education_levels array<string>")
    want = [r.x for r in rows.orderBy("id").select(F.array_compact(F.transform("education_levels", education.level_rank)).alias("x")).collect()]
    for most in (100, 1):
        got = education.with_ranks(rows, most=most)
        assert got.columns == ["id", "education_levels", "education_ranks"] and [r.education_ranks for r in got.orderBy("id").collect()] == want
    assert education.with_ranks(rows.where("false")).count() == 0
