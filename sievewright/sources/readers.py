"""Sources: validated JSON artifacts, files as bytes, fixtures, profiles."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas
from ..functions.markup import decoded, structure
from ..operators.admission import enabled_sources
from ..operators.pages import inspection, resource_kind
from ..session import ready, stored
from .artifacts import LISTED


def json_artifact(spark: SparkSession, path: str | list[str], schema: str) -> DataFrame:
    """Rows of a JSON artifact in a fixed schema; a malformed one stops the read. A byte order mark is no part of it."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def json_parts(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of an artifact in files: those that its list names, each an array that one task reads. A file that is missing or malformed stops the read."""
    listed = json_artifact(spark, f"{path}/{LISTED}", "files array<string>").first()
    names = [f"{path}/{n}" for n in listed.files] if listed else []
    return json_artifact(spark, names, schema) if names else spark.createDataFrame([], schema)


def optional_artifact(spark: SparkSession, paths: list[str], schema: str) -> DataFrame:
    """The first of ``paths`` that can be read, else no rows."""
    for p in paths:
        try:
            return json_artifact(spark, p, schema)
        except AnalysisException:
            continue
    return spark.createDataFrame([], schema)


def files(spark: SparkSession, path: str, most_bytes: int = 2_000_000) -> DataFrame:
    """Files as responses: ``url``, ``body``; larger ones come without their content but are not left out."""
    raw = spark.read.format("binaryFile").load(path)
    return raw.select(F.col("path").alias("url"), F.when(F.col("length") <= most_bytes, F.col("content")).alias("body"), F.col("length").alias("size"))


def acquired(responses: DataFrame, most_bytes: int = 2_000_000) -> DataFrame:
    """Responses (url, body, status_code, content_type, content_encoding) to pages: kind, decoding, flaws, whether a browser should try."""
    d = responses.withColumn("_d", decoded("body", F.coalesce("content_type", F.lit("")), F.coalesce("content_encoding", F.lit(""))))
    html = F.coalesce("_d.text", F.lit(""))
    flaws = F.when(F.col("_d.error").isNotNull(), F.array(F.lit("decode_failed"))).otherwise(inspection(html, F.col("status_code"), F.col("content_type"), most_bytes))
    # Flaws that a rendered page may be free of.
    retry = F.arrays_overlap(flaws, F.array(*map(F.lit, ("empty_page", "javascript_shell", "access_interstitial", "binary_or_mojibake", "decode_failed"))))
    return d.select("url", "status_code", resource_kind(F.col("content_type")).alias("kind"), F.col("_d.text").alias("html"), "_d.charset", flaws.alias("flaws"), retry.alias("browser_fallback"))


def prior_followups(spark: SparkSession, folder: str) -> DataFrame:
    """Follow-ups of an earlier run: those in its report, else the artifact of their own, else none; a broken file holds none."""
    shape = schemas.FOLLOWUP
    for name, whole in (("page_acquisition_report.json", False), ("pending_followups.json", True)):
        reader = spark.read.schema(shape if whole else f"pending_followups array<struct<{shape}>>").option("multiLine", True).option("mode", "DROPMALFORMED")
        try:
            rows = reader.json(f"{folder}/{name}")
        except AnalysisException:
            continue
        return rows if whole else rows.select(F.inline("pending_followups"))
    return spark.createDataFrame([], shape)


def fetched(sources: DataFrame, make: Callable[[], Callable[[str], tuple[bytes, int | None, str, dict]]], retries: int = 2, most_bytes: int = 2_000_000, pause: float = 0.25, browser: bool = False) -> DataFrame:
    """``url``, ``body``, ``status_code``, ``final_url``, ``content_type``, ``content_encoding``, ``attempts``, ``fetch_method``, ``fetch_error`` per source.

    ``make`` builds a function of an address once per task, which returns (bytes, status, final address, headers). A
    fetch that fails is tried again up to ``retries`` times, after pauses that grow to a second; then the row carries its
    error. A body above ``most_bytes`` is an error too.
    """
    ready(sources.sparkSession)
    names = ["url", "body", "status_code", "final_url", "content_type", "content_encoding", "attempts", "fetch_method", "fetch_error"]

    def one(get: Callable, url: str) -> tuple:
        error = None
        for n in range(1, max(0, retries) + 2):
            try:
                body, status, final, headers = get(url)
                if len(body) > most_bytes:
                    raise ValueError(f"response exceeds limit: {len(body)} bytes")
                head = {k.lower(): v for k, v in headers.items()}
                return url, body, status, final, head.get("content-type", ""), head.get("content-encoding", ""), n, "browser" if browser else "http", None
            except Exception as e:
                error = f"{type(e).__name__}: {e}"
                if n <= retries:
                    time.sleep(min(pause * n, 1.0))
        return url, None, None, None, None, None, max(0, retries) + 1, "browser" if browser else "http", error

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        get = make()
        for batch in batches:
            yield pd.DataFrame([one(get, u) for u in batch["url"]], columns=names).astype({"status_code": "Int32", "attempts": "Int32"})

    return sources.select("url").mapInPandas(run, "url string, body binary, status_code int, final_url string, content_type string, content_encoding string, attempts int, fetch_method string, fetch_error string")


def with_fallback(first: DataFrame, rendered: DataFrame) -> DataFrame:
    """Responses with ``browser_fallback``; where it is set the rendered response, and both errors if that failed too."""
    again = rendered.select("url", F.struct(*(c for c in rendered.columns if c != "url")).alias("_r"))
    d = first.join(again, "url", "left")
    use = F.coalesce("browser_fallback", F.lit(False)) & F.col("_r").isNotNull() & F.col("_r.fetch_error").isNull()
    both = F.concat(F.coalesce("fetch_error", F.lit("technical check failed")), F.lit("; browser: "), F.col("_r.fetch_error"))
    error = F.when(use, None).when(F.coalesce("browser_fallback", F.lit(False)) & F.col("_r.fetch_error").isNotNull(), both).otherwise(F.col("fetch_error"))
    other = [c for c in rendered.columns if c not in ("url", "fetch_error") and c in first.columns]
    return d.withColumns({c: F.when(use, F.col(f"_r.{c}")).otherwise(F.col(c)) for c in other} | {"fetch_error": error}).drop("_r")


def acquire(sources: DataFrame, fetch: Callable[[DataFrame], DataFrame], render: Callable[[DataFrame], DataFrame] | None = None, most_bytes: int = 2_000_000) -> tuple[DataFrame, DataFrame]:
    """(pages of ``sources`` with title, text and links, one row of counts): a fetch of all, a rendered one of those it leaves with a flaw.

    ``fetch`` and ``render`` take addresses (``url``) and give responses as :func:`fetched` does. The first pass is stored
    before it is judged, so the second asks only for rows that failed, could not be decoded, or look like an empty page,
    a shell of scripts or a wall; its answer counts where it is one, and both errors where it is not. Structure is
    worked out once, of what counts in the end; a page keeps the flaws that are left.
    """
    ready(sources.sparkSession)
    first = stored(fetch(sources.select("url").distinct()), "first-pass")
    judged = first.join(acquired(first).select("url", "flaws", "browser_fallback"), "url")
    judged = judged.withColumn("browser_fallback", F.col("fetch_error").isNotNull() | F.coalesce("browser_fallback", F.lit(False)))
    if render is not None:
        again = stored(render(judged.where("browser_fallback").select("url")), "second-pass")
        judged = with_fallback(judged.drop("flaws"), again)
    final = stored(judged.drop("flaws", "browser_fallback"), "responses")
    pages = acquired(final.where("fetch_error is null"), most_bytes).drop("browser_fallback")
    told = pages.join(final.select("url", "final_url", "attempts", "fetch_method"), "url").withColumn("_s", structure("html", F.coalesce("final_url", "url")))
    errors = final.where("fetch_error is not null").select("url", "fetch_method", "attempts", "fetch_error")
    whole = told.select("*", "_s.title", "_s.text", "_s.links").drop("_s").unionByName(errors, allowMissingColumns=True)
    none = F.coalesce(F.size("flaws"), F.lit(0)) == 0
    rendered = F.col("fetch_method") == "browser"
    counts = whole.agg(F.count("*").alias("sources"), F.count_if(rendered).alias("rendered"), F.count_if(F.col("fetch_error").isNotNull()).alias("failed"), F.count_if(F.col("fetch_error").isNull() & none).alias("clean"), F.count_if(~none).alias("flawed"))
    return whole, counts


# Sources that a search without a network answers with.
MOCK_SOURCES = (
    ("mock://future-bank/campus", "Future Bank Technology Graduate Careers", "Future Bank Careers", "Sydney; Shanghai", True, 94, "Official bank graduate source matching: "),
    ("mock://global-tech/graduates", "Global Tech Graduate Jobs", "Global Tech Careers", "Remote", True, 88, "Official technology graduate source with software and data roles."),
    ("mock://unrelated-forum/thread", "General career discussion thread", "Unrelated Forum", None, False, 28, "Low-confidence discussion page, not a direct application source."),
)


def mock_sources(spark: SparkSession, queries: tuple[str, ...] = ()) -> DataFrame:
    """Three sources; the first one's reason names the first three queries."""
    rows = [(k, u, t, n, place, official, score, why + ", ".join(queries[:3]) if k == 0 else why) for k, (u, t, n, place, official, score, why) in enumerate(MOCK_SOURCES)]
    return spark.createDataFrame(rows, "ord int, url string, title string, source_name string, location string, is_official boolean, relevance_score int, reason string")


def manual_sources(spark: SparkSession, rows: list[dict]) -> DataFrame:
    """Given sources as they are, in their order."""
    names = [c.split(" ")[0] for c in schemas.SOURCE.split(", ")]
    return spark.createDataFrame([(k, *(r.get(c) for c in names[1:])) for k, r in enumerate(rows)], schemas.SOURCE)


def config_file(folder: str, name: str) -> tuple[dict, bool]:
    """(content of a configuration file, whether it is the example): a private file goes before the example."""
    import yaml

    own = os.path.join(folder, f"{name}.yaml")
    example = not os.path.exists(own)
    with open(os.path.join(folder, f"{name}.example.yaml") if example else own, encoding="utf-8") as f:
        return yaml.safe_load(f) or {}, example


def configured_sources(spark: SparkSession, folder: str) -> DataFrame:
    """The enabled sources of a configuration folder."""
    shape = "ord long, url string, title string, name string, company_name string, company_type string, location string, official boolean, relevance_score int, kind string, enabled boolean"
    listed = config_file(folder, "sources")[0].get("sources") or []
    rows = [(k, r["url"], None, r.get("name"), r.get("company_name"), r.get("company_type"), r.get("location"), bool(r.get("official")), r.get("relevance_score"), r.get("type"), bool(r.get("enabled"))) for k, r in enumerate(listed)]
    d = spark.createDataFrame(rows, shape)
    kept = enabled_sources(d)
    more = d.select("ord", "company_name", "company_type", "location", F.col("official").alias("is_official"), F.concat(F.lit("Manually configured source: "), F.coalesce("kind", F.lit("unknown"))).alias("reason"))
    return kept.join(more, "ord")


def prompt_text(folder: str, name: str) -> str:
    """Instructions of a stage by name; a byte order mark is no part of them."""
    path = os.path.join(folder, f"{name}.md")
    if not os.path.exists(path):
        raise FileNotFoundError(f"no prompt of this name: {name}")
    with open(path, encoding="utf-8-sig") as f:
        return f.read()


def mock_pages(sources: DataFrame, texts: DataFrame) -> DataFrame:
    """Pages of known addresses; an unknown one has empty text."""
    return sources.join(texts, "url", "left").withColumn("text", F.coalesce("text", F.lit("")))


def profile(spark: SparkSession, values: dict) -> DataFrame:
    """A profile's single row; lists are cleaned and a place cannot be both wanted and excluded."""
    clean = lambda xs: list({x.strip().lower(): x.strip() for x in reversed(xs or []) if x.strip()}.values())[::-1]
    lists = {k: clean(values.get(k)) for k in ("target_roles", "skills", "preferred_company_types", "preferred_locations", "excluded_locations")}
    both = {x.lower() for x in lists["preferred_locations"]} & {x.lower() for x in lists["excluded_locations"]}
    if both:
        raise ValueError(f"preferred and excluded: {', '.join(sorted(both))}")
    row = [values.get("education", "").strip(), values.get("graduation_date", "").strip(), *lists.values()]
    return spark.createDataFrame([tuple(row)], schemas.PROFILE)
