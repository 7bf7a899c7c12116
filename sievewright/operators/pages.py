"""Pages: technical state, triage, cleaning, excerpts, links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.markup import recovered
from ..functions.urls import canonical_url
from ..functions.text import CHROME_LINES, EXCERPT_MARKERS, all_reasons, blank_to_null, bound, collapse, contained, lines

# Words that speak for a posting, against a page, and for a log-in wall.
POSTING_WORDS = (
    "岗位职责", "任职要求", "职位描述", "工作地点", "招聘类别", "立即申请", "投递", "校园招聘", "校招", "应届", "招聘公告",
    "responsibilities", "requirements", "qualifications", "location", "apply", "graduate program", "graduate programme", "graduate jobs", "early careers", "job description",
)
REJECTION_WORDS = (
    "404", "not found", "page unavailable", "page not found", "access denied", "forbidden", "页面不存在", "页面未找到", "职位已下线", "岗位已下线", "招聘已结束", "已停止招聘",
    "no longer accepting applications", "job is no longer available", "position has been filled", "applications are closed",
)
LOGIN_WORDS = ("登录", "注册", "login", "sign in")
# Codes that reasons keep.
CODES = (
    "fetch_error", "bad_status_code", "redirected_to_error_page", "rejection_keywords", "auth_wall", "insufficient_visible_text",
    "html_body_empty", "recoverable_metadata_present", "needs_manual_review",
)
# What marks a link's kind, in order of judgement.
FILES = "(?i)\\.(pdf|docx?|xlsx?)$"
APPLY = "apply|application|submit|resume|申请|报名|应聘"
SOURCE = "source|来源"
DETAIL_LABEL = "job details|view job|view position|详情|职位详情|查看职位"
DETAIL_PATH = "(^|/)(jobs?|positions?|vacanc(y|ies)|roles?)(/|$)"
LINK_RANK = {"apply": 0, "job_detail_candidate": 1, "attachment": 2, "source": 3, "other": 4}


def resource_kind(content_type: Column) -> Column:
    c = F.lower(F.coalesce(content_type, F.lit("")))
    return F.when(c.contains("pdf"), "pdf").when(c.startswith("image/"), "image").when(c.contains("json"), "json").when(c.contains("html"), "html").when((c != "") & ~c.startswith("text/"), "binary").otherwise("unknown")


def header(headers: Column, name: str) -> Column:
    """A header's value whatever the case of its name; the first if there are several."""
    return F.get(F.filter(F.map_entries(headers), lambda e: F.lower(e["key"]) == name.lower()), F.lit(0))["value"]


def inspection(html: Column, status: Column, content_type: Column, most_bytes: int = 2_000_000) -> Column:
    """Technical flaws of a response. A blank page is not looked at further."""
    bare = F.regexp_replace(F.regexp_replace(html, "(?is)<script\\b[^>]*>.*?</script\\s*>", " "), "<[^>]+>", " ")
    visible, low = collapse(bare), F.lower(html)
    shell = low.rlike("<(?:div|main)[^>]+(?:id|class)=[\"'][^\"']*(?:app|root|__next)[^\"']*[\"'][^>]*>\\s*</")
    scripts = low.rlike("<script[^>]+src=[\"'][^\"']+\\.js(?:[\"']|\\?)")
    control = F.length(html) - F.length(F.regexp_replace(html, "[\\x00-\\x08]", ""))
    kind = F.lower(F.coalesce(content_type, F.lit("")))
    bad_status = (status.isNotNull() & ~status.between(200, 299), F.concat(F.lit("http_status_"), status.cast("string")))
    blank = F.trim(F.regexp_replace(html, "(?U)\\s+", " ")) == ""
    return F.when(blank, all_reasons(bad_status, (F.lit(True), "empty_page"))).otherwise(
        all_reasons(
            bad_status,
            (F.octet_length(html) > most_bytes, "response_too_large"),
            (kind.rlike("application/json|application/pdf|image/"), "non_html_resource"),
            (html.contains("\x00") | (control > 3) | html.contains("�"), "binary_or_mojibake"),
            (shell | (scripts & (F.length(visible) < 200)), "javascript_shell"),
            (visible.rlike("(?i)access denied|forbidden|captcha|verify you are human|unusual traffic"), "access_interstitial"),
        )
    )


def recovery_sources(html: Column, links: Column | None = None, strict: bool = True) -> Column:
    """Hidden content a page seems to hold. ``strict`` is triage's reading: closing quotes, two more state names, links."""
    end = "[\"']" if strict else ""
    state = "window\\.|__INITIAL_STATE__|__NEXT_DATA__|__APOLLO_STATE__|application/json" if strict else "__INITIAL_STATE__|__NEXT_DATA__|application/json"
    found = [
        (html.rlike(f"(?i)<script[^>]+type=[\"']application/ld\\+json{end}"), "json_ld"),
        (html.rlike(f"(?i)<meta[^>]+property=[\"']og:description{end}"), "og_description"),
        (html.rlike(f"(?i)<meta[^>]+name=[\"']description{end}"), "meta_description"),
        (html.rlike(f"(?i){state}"), "embedded_json"),
    ]
    if strict and links is not None:
        found.append((F.size(links) > 0, "important_links"))
    return all_reasons(*found)


def recovery(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` with ``recovered`` (see :func:`sievewright.functions.markup.recover`): hidden content of each page, and how it was found.

    Only pages that show one of the four marks of hidden content go through Python; what the others come to is the same
    for all of them and stays an expression. Null HTML has no marks.
    """
    some = F.size(bound(F.coalesce(html, F.lit("")), lambda h: recovery_sources(h, strict=False))) > 0
    none = F.struct(F.lit(False).alias("success"), F.lit(None).cast("string").alias("source"), F.lit("").alias("text"), F.array().cast("array<string>").alias("attempted"), F.array(F.lit("no_deterministic_recovery_source_succeeded")).alias("reasons"))
    return pages.where(some).withColumn("recovered", recovered(html)).unionByName(pages.where(~some).withColumn("recovered", none))


def signals(text: Column) -> Column:
    return contained(text, POSTING_WORDS)


# Words that speak for a plan beside its own terms.
PLAN_WORDS = ("graduate", "campus", "2026", "2027", "校招", "应届")


def plan_signals(text: Column, *terms: Column) -> Column:
    """Terms of a search plan (lists) and plan words that lower-case ``text`` holds, sorted, each once."""
    given = F.concat(*(F.coalesce(t, F.array().cast("array<string>")) for t in terms), F.array(*map(F.lit, PLAN_WORDS)))
    return F.array_sort(F.array_distinct(F.filter(given, lambda t: F.coalesce((t != "") & F.contains(text, F.lower(t)), F.lit(False)))))


def ai_input(pages: DataFrame) -> DataFrame:
    """What analysis reads of a page: what its source told (``metadata``), the cleaned text, the telling links.

    ``pages``: url, source_name, title, metadata (map), visible_text, important_links and any keys, which stay. Blank
    values of the source count as none.
    """
    told = lambda k: blank_to_null(F.get(F.filter(F.map_entries(F.coalesce("metadata", F.create_map().cast("map<string,string>"))), lambda e: e["key"] == k), F.lit(0))["value"])
    own = ("url", "source_name", "title", "visible_text", "important_links", "metadata")
    return pages.select(
        *(c for c in pages.columns if c not in own), "url", told("final_url").alias("final_url"), "source_name", told("company_name").alias("source_company_name"), told("company_type").alias("company_type"),
        told("location").alias("source_location"), F.coalesce(F.lower(told("is_official")) == "true", F.lit(False)).alias("is_official"), "title", "visible_text", "important_links",
    )


def analysis_trace(pages: DataFrame, original: str, removed: str, most: int = 6000, method: str = "lines") -> DataFrame:
    """How a page became what a model is shown: sizes before and after, lines that went, the excerpt and whether it was cut."""
    text = excerpt(F.col("title"), F.col("visible_text"), most)
    told = pages.withColumn("classification_text", text).withColumn("classification_text_length", F.length("classification_text"))
    return told.select(
        "url", F.lit(method).alias("cleaning_method"), F.length(original).alias("original_chars"), F.length("visible_text").alias("cleaned_chars"), F.col(removed).alias("removed_line_count"),
        "classification_text", "classification_text_length", ((F.col("classification_text_length") >= most) & (F.length("title") + F.length("visible_text") > most)).alias("classification_truncated"),
    )


def login_wall(title: Column, url: Column, text: Column, has_signals: Column) -> Column:
    """A log-in word in title or address, or in a short text without posting words."""
    either = "|".join(LOGIN_WORDS)
    head = F.lower(F.concat_ws(" ", title, url)).rlike(either)
    return head | (F.lower(text).rlike(either) & ~has_signals & (F.length(text) < 1200))


def route(pages: DataFrame, least: int = 300) -> DataFrame:
    """``pages`` (url, title, text, html, status_code, final_url, fetch_error) with ``status``, ``reasons`` and ``codes``.

    Hard reasons reject a page; short text makes it recoverable; the rest is readable.
    """
    every = F.lower(F.concat_ws(" ", F.coalesce("title", F.lit("")), "url", F.coalesce("text", F.lit(""))))
    text = F.coalesce("text", F.lit(""))
    bad, posting = contained(every, REJECTION_WORDS), signals(every)
    wall = login_wall(F.coalesce("title", F.lit("")), F.col("url"), text, F.size(posting) > 0)
    named = lambda label, found: F.concat(F.lit(label + ": "), F.array_join(F.slice(found, 1, 5), ", "))
    redirect = F.coalesce((canonical_url(F.col("final_url")) != canonical_url(F.col("url"))) & F.col("final_url").rlike("[?&]error=[^&#]"), F.lit(False))
    hard = all_reasons(
        (F.coalesce(F.col("fetch_error") != "", F.lit(False)), F.concat(F.lit("fetch_error: "), "fetch_error")),
        (F.col("status_code").isNotNull() & ~F.col("status_code").between(200, 399), F.concat(F.lit("bad_status_code: "), F.col("status_code").cast("string"))),
        (redirect, F.concat(F.lit("redirected_to_error_page: "), "final_url")),
        (F.size(bad) > 0, named("rejection_keywords", bad)),
        (wall, named("auth_wall", contained(every, LOGIN_WORDS))),
    )
    size = F.length(F.trim(F.regexp_replace(text, "^(?U)\\s+|\\s+$", "")))
    sources = recovery_sources(F.coalesce("html", F.lit("")))
    empty_body = (F.length(F.coalesce("html", F.lit(""))) > 1000) & (size <= 30)
    soft = F.when(size >= least, F.array().cast("array<string>")).otherwise(
        all_reasons(
            (F.lit(True), F.concat(F.lit("insufficient_visible_text: "), size.cast("string"), F.lit(f" < {least}"))),
            (F.size(sources) > 0, F.concat(F.lit("recoverable_metadata_present: "), F.array_join(sources, ", "))),
            (F.size(posting) > 0, "candidate_signal_present"),
            (empty_body, "html_body_empty"),
            (~empty_body, "needs_manual_review"),
        )
    )
    judged = pages.withColumn("_hard", hard).withColumn("_soft", soft)
    reasons = F.when(F.size("_hard") > 0, F.col("_hard")).otherwise(F.col("_soft"))
    status = F.when(F.size("_hard") > 0, "rejected").when(F.size("_soft") > 0, "recoverable").otherwise("readable")
    return judged.select(*pages.columns, status.alias("status"), reasons.alias("reasons"), F.transform(reasons, reason_code).alias("codes"))


def reason_code(reason: Column) -> Column:
    """A missing page, else a forbidden one, else what stands before the colon if it is a known code."""
    low, head = F.lower(reason), F.substring_index(reason, ":", 1)
    return F.when(low.contains("404") | low.contains("not found"), "not_found").when(low.rlike("401|403|access denied|forbidden"), "access_denied").when(head.isin(*CODES), head).otherwise("needs_manual_review")


def quality_failure(status: Column, error: Column, text: Column, least: int = 300) -> Column:
    """Why a page is not worth analysing; null if it is."""
    size = F.length(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(F.coalesce(error != "", F.lit(False)), "fetch_error").when(status.isNotNull() & ~status.between(200, 399), "bad_status").when(size < least, "text_too_short")


def clean_lines(pages: DataFrame, key: str = "page_id", text: str = "text") -> DataFrame:
    """A row per line of every page: ``pos`` (from 0), ``line``, ``times`` (in its page), ``kept``.

    Furniture goes: known phrases, link lists, short repeated labels, and short unpunctuated lines near the page's ends
    that stand among others of the kind. Repeats are counted and neighbours seen by windows over the page's lines.
    """
    rows = pages.select(key, F.posexplode(lines(F.col(text))).alias("pos", "raw")).select(key, "pos", collapse(F.col("raw")).alias("line"))
    page = Window.partitionBy(key)
    words, size = F.size(F.filter(F.split("line", " "), lambda w: w != "")), F.length("line")
    short = ((size > 0) & (size <= 48) & (words <= 6)).cast("int")
    wide = rows.withColumns({"times": F.count("*").over(Window.partitionBy(key, "line")), "_n": F.count("*").over(page), "_near": F.sum(short).over(page.orderBy("pos").rowsBetween(-2, 2))})
    links = F.size(F.regexp_extract_all("line", F.lit("(?i)(https?://\\S+)"), F.lit(1)))
    chrome = F.lower("line").isin(*CHROME_LINES)
    linked = (links >= 2) | ((links >= 1) & (words <= 6) & (links / words >= 0.5))
    label = (size <= 40) & ~F.contains("line", F.lit(":")) & (F.col("times") >= 2)
    edge = (F.col("_n") >= 6) & ((F.col("pos") < 8) | (F.col("pos") >= F.greatest(F.col("_n") - 8, F.lit(0))))
    shaped = ~F.contains("line", F.lit(":")) & ~F.startswith("line", F.lit("---")) & (size <= 48) & ~F.col("line").rlike("[.!?。！？]") & (words <= 6)
    frame = shaped & edge & (F.col("_near") >= 3) & ((words <= 3) | F.col("line").rlike("[|›»→]"))
    return wide.select(key, "pos", "line", "times", ((size > 0) & ~chrome & ~linked & ~label & ~frame).alias("kept"))


def cleaned_text(judged: DataFrame, key: str = "page_id", most: int = 12_000) -> DataFrame:
    """Kept lines of :func:`clean_lines` joined again, with counts; cut at ``most`` characters."""
    held = judged.groupBy(key).agg(F.array_sort(F.collect_list(F.when(F.col("kept"), F.struct("pos", "line")))).alias("_l"), F.count("*").alias("original_line_count"), F.count_if("kept").alias("kept_line_count"))
    whole = F.array_join(F.transform("_l", lambda x: x["line"]), "\n")
    cut = F.when(F.length(whole) > most, F.rtrim(F.substring(whole, 1, most))).otherwise(whole)
    return held.select(key, cut.alias("text"), "original_line_count", "kept_line_count", (F.col("original_line_count") - F.col("kept_line_count")).alias("removed_line_count"), (F.length(whole) > most).alias("truncated"))


def main_text(extracted: Column, visible: Column, least: int = 300, method: str = "extractor") -> Column:
    """``method`` and ``text`` to clean: the main body that an extractor found where it holds ``least`` characters, else the visible lines.

    ``extracted`` is whatever finds a page's body: an expression over its HTML, or a pandas function that calls a library.
    """
    enough = F.coalesce(F.length(F.trim(extracted)) >= least, F.lit(False))
    return F.when(enough, F.struct(F.lit(method).alias("method"), extracted.alias("text"))).otherwise(F.struct(F.lit("fallback_text").alias("method"), F.coalesce(visible, F.lit("")).alias("text")))


def excerpt(title: Column, text: Column, most: int = 6000, block: int = 12) -> Column:
    """Blocks of lines from each heading on; without headings the text's head and tail, which may overlap."""
    marks, name = "|".join(EXCERPT_MARKERS), F.trim(F.coalesce(title, F.lit("")))
    filled = lambda *xs: F.filter(F.array(*xs), lambda x: x != "")

    def whole(body: Column) -> Column:
        head = F.substring(body, 1, most // 2)
        tail = F.when(F.length(body) > most // 2, F.right(body, F.least(F.length(body), F.lit(most) - F.length(head)))).otherwise("")
        return filled(name, head, tail)

    def parts(rows: Column) -> Column:
        starts = F.filter(F.transform(rows, lambda x, i: F.when(F.lower(x).rlike(marks), i)), lambda i: i.isNotNull())
        blocks = F.transform(starts, lambda i: F.array_join(F.slice(rows, i + 1, F.lit(block)), "\n"))
        return bound(blocks, lambda b: F.when(F.size(b) > 0, F.concat(filled(name), b)).otherwise(bound(F.array_join(rows, "\n"), whole)))

    found = bound(F.filter(F.transform(lines(text), lambda x: F.trim(x)), lambda x: x != ""), parts)
    return F.rtrim(F.substring(F.array_join(found, "\n"), 1, most))


def link_kind(url: Column, label: Column) -> Column:
    """apply, attachment, source or detail candidate; null for any other link."""
    path = F.lower(F.regexp_extract(url, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)", 1))
    low = F.lower(F.coalesce(label, F.lit("")))
    detail = low.rlike(DETAIL_LABEL) | (path.rlike(DETAIL_PATH) & ~path.rlike("apply|search|filter"))
    return F.when(path.rlike(FILES), "attachment").when(low.rlike(APPLY), "apply").when(low.rlike(SOURCE), "source").when(detail, "job_detail_candidate")


def important_links(pages: DataFrame, key: str = "page_id", most: int = 10) -> DataFrame:
    """The ``most`` telling links of each page (``links``: href and text, absolute; ``text``), by kind, then place.

    A link that is of no kind does not stand in the way of a later one to the same address. Addresses written out near
    a word of applying count as links to apply.
    """
    anchors = pages.select(key, F.posexplode("links").alias("at", "l")).select(key, F.lit(0).alias("part"), "at", F.col("l.href").alias("url"), F.trim("l.text").alias("label"))
    anchors = anchors.where("url <> ''").withColumn("kind", link_kind(F.col("url"), F.col("label"))).where("kind is not null")
    own = F.filter(F.transform(lines(F.col("text")), lambda x: F.trim(x)), lambda x: x != "")
    near = Window.partitionBy(key).orderBy("at")
    written = pages.select(key, F.posexplode(own).alias("at", "label")).withColumn("_near", F.lower(F.concat_ws(" ", F.lag("label").over(near), "label", F.lead("label").over(near))))
    written = written.where(F.col("_near").rlike("apply|application|申请|报名|应聘")).select(key, F.lit(1).alias("part"), "at", F.explode(F.regexp_extract_all("label", F.lit("(https?://[^\\s<>\"']+)"), F.lit(1))).alias("url"), "label")
    written = written.withColumn("url", F.regexp_replace("url", "[.,;:!?)\\]}，。；：！？）】』]+$", "")).withColumn("kind", F.lit("apply")).where(~F.regexp_replace("url", "[?#].*$", "").rlike(FILES))
    rank = F.lit(4)
    for kind, r in LINK_RANK.items():
        rank = F.when(F.col("kind") == kind, r).otherwise(rank)
    first = Window.partitionBy(key, "url").orderBy("part", "at")
    every = anchors.unionByName(written).withColumn("_n", F.row_number().over(first)).where("_n = 1").withColumn("_rank", rank)
    return every.withColumn("place", F.row_number().over(Window.partitionBy(key).orderBy("_rank", "part", "at"))).where(F.col("place") <= most).select(key, "place", "url", "label", "kind")
