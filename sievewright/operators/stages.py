"""Stages that ask a model: what is asked, what an answer must hold, results and errors as tables.

Requests (key, ``prompt``) go to :mod:`sievewright.sources.providers`, which gives answers (key, ``answer``, ``error``);
each stage here joins them with its rows. A row whose answer is missing or does not fit becomes an error row (stage,
key, reason) and no other row is touched.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import schemas
from ..plans.numbering import numbered
from ..session import stored
from ..sources.providers import parsed
from .eligibility import assess
from .followups import NEXT_ACTION, route_types
from .pages import excerpt
from .records import last_wins, merged_context, payload

# What closes every instruction, and the values that answers may hold.
JSON_ONLY = "Return ONLY valid JSON. Do not include Markdown or explanations."
ROLE_FITS = ("high", "medium", "low", "unclear")
MUST_HAVE_FITS = ("yes", "partial", "no", "unclear")
CONFIDENCES = ("high", "medium", "low")
SENIORITIES = ("internship", "graduate", "entry_level", "experienced", "leadership", "unclear")

CLASSIFICATION = "page_type string, suggested_next_action string, reasons array<string>, evidence array<string>"
VERDICT = "role_fit string, must_have_fit string, match_reasons array<string>, missing_requirements array<string>, risk_flags array<string>, confidence string"


def json_prompt(instructions: str, body: Column, schema: str = "") -> Column:
    """Instructions, the demand for JSON, the schema where there is one, and the input, apart by blank lines."""
    head = [p for p in (instructions.strip(), JSON_ONLY, f"Output schema:\n{schema}" if schema else "") if p]
    return F.concat(F.lit("\n\n".join([*head, "Input:\n"])), body)


def errors_of(rows: DataFrame, stage: str, key: str, *known: str) -> DataFrame:
    """Rows whose ``error`` is not null as the errors of a stage; a row that names its own stage keeps it."""
    own = F.coalesce("stage", F.lit(stage)) if "stage" in rows.columns else F.lit(stage)
    return rows.where("error is not null").select(own.alias("stage"), key, *known, F.col("error").alias("reason"))


def reported_errors(rows: DataFrame, stage: str, item: str = "item") -> DataFrame:
    """Errors that a report lists in any form as rows: ``stage``, ``reason``, ``url``, ``title``, ``deduplication_key``; other columns stay.

    An item is JSON text. An object with a reason keeps its fields, and its own stage where it names one; anything else is
    the reason itself, as it stands.
    """
    told = F.from_json(item, "stage string, reason string, url string, title string, deduplication_key string")
    object_ = F.coalesce(F.trim(F.col(item)).startswith("{"), F.lit(False)) & F.col("_t.reason").isNotNull()
    rest = [c for c in rows.columns if c != item]
    quoted = F.trim(F.col(item)).startswith('"')
    bare = F.coalesce(F.when(quoted, F.from_json(F.concat(F.lit('{"x":'), item, F.lit("}")), "x string")["x"]), F.col(item))  # a JSON string loses its quotes
    return rows.withColumn("_t", told).select(
        *rest, F.when(object_, F.coalesce("_t.stage", F.lit(stage))).otherwise(stage).alias("stage"), F.when(object_, F.col("_t.reason")).otherwise(bare).alias("reason"),
        *(F.when(object_, F.col(f"_t.{c}")).alias(c) for c in ("url", "title", "deduplication_key")),
    )


def _judged(rows: DataFrame, answers: DataFrame, key: str, schema: str, fits: Column) -> DataFrame:
    """``rows`` with ``value`` and ``error``; an answer that does not hold ``fits`` is none."""
    told = parsed(answers.select(key, "answer", "error", *(c for c in answers.columns if c == f"_{key}")), schema)
    told = told.withColumn("error", F.coalesce("error", F.when(~F.coalesce(fits, F.lit(False)), "answer does not fit its schema")))
    joined = rows.join(told.select(key, "value", F.col("error").alias("error"), F.lit(True).alias("_told")), key, "left")
    return joined.withColumn("error", F.coalesce("error", F.when(F.col("_told").isNull(), "no recorded answer"))).drop("_told")


# Classification of pages.


def classification_requests(pages: DataFrame, instructions: str, key: str = "page_id") -> DataFrame:
    """Title, excerpt and telling links of each page, the types it may have among the instructions."""
    shown = F.struct(F.col("title"), excerpt(F.col("title"), F.col("visible_text")).alias("visible_text"), F.col("important_links"))
    body = F.to_json(F.struct(shown.alias("page"), F.array(*map(F.lit, NEXT_ACTION)).alias("allowed_page_types")), {"ignoreNullFields": "false"})
    return pages.select(key, json_prompt(instructions, body).alias("prompt"))


def classified(pages: DataFrame, answers: DataFrame, key: str = "page_id") -> tuple[DataFrame, DataFrame]:
    """(pages with page_type, reasons, next_action, pending_kind, priority, errors).

    The next action follows from the type, whatever the answer suggests.
    """
    judged = _judged(pages, answers, key, CLASSIFICATION, F.col("value.page_type").isin(*NEXT_ACTION))
    good = judged.where("error is null").withColumns({"page_type": F.col("value.page_type"), "reasons": F.coalesce("value.reasons", F.array().cast("array<string>"))})
    return route_types(good.drop("value", "error")), errors_of(judged, "page_classification", key)


# Extraction of jobs from batches of pages.


def batched(pages: DataFrame, order: str, size: int) -> DataFrame:
    """``pages`` with ``batch``: runs of ``size`` in order, numbered by ranges rather than in one task."""
    return numbered(pages, order).withColumn("batch", F.floor((F.col("row_no") - 1) / size).cast("long")).drop("row_no")


def extraction_requests(pages: DataFrame, instructions: str, order: str = "page_id") -> DataFrame:
    """One request per batch: the payloads of its pages in order."""
    shown = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), payload("page").alias("p"))))
    bodies = pages.groupBy("batch").agg(F.array_join(F.transform(shown, lambda x: x["p"]), ",").alias("_b"))
    return bodies.select("batch", json_prompt(instructions, F.concat(F.lit('{"pages":['), F.col("_b"), F.lit("]}"))).alias("prompt"))


def judged_batches(pages: DataFrame, answers: DataFrame) -> DataFrame:
    """``batch``, ``value`` and ``error`` of each batch of ``pages``: an answer is a list with exactly one entry per page of its batch."""
    told = parsed(answers.select("batch", "answer", "error"), f"array<struct<{schemas.EXTRACTION}>>")
    asked = pages.groupBy("batch").agg(F.array_sort(F.collect_list(F.col("page_id").cast("string"))).alias("_asked"))
    ids = F.array_sort(F.transform("value", lambda x: x["page_id"]))
    error = F.coalesce(
        "error", F.when(F.col("value").isNull(), "no recorded answer"), F.when(F.size(F.array_distinct(ids)) < F.size(ids), "AI extraction returned duplicate page_id values."),
        F.when(~ids.eqNullSafe(F.col("_asked")), "AI extraction page_id values do not match the input pages."),
    )
    return asked.join(told, "batch", "left").select("batch", "value", error.alias("error"))


def _taken_apart(pages: DataFrame, judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    held = judged.where("error is null").select("batch", F.explode("value").alias("_v")).select("batch", "_v.page_id", "_v.page_context", "_v.jobs")
    raw = merged_context(pages.withColumn("page_id", F.col("page_id").cast("string")).join(held, ["batch", "page_id"]))
    failed = pages.select("batch", "page_id", "url").join(judged.select("batch", "error"), "batch")
    return raw, errors_of(failed, "job_extraction", "page_id", "url")


def extracted(pages: DataFrame, answers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(raw records of the jobs in the answers, one error per page of each batch that failed).

    ``pages``: batch, page_id and what :func:`merged_context` reads. An answer that repeats a page or leaves one out or
    adds one fails as a whole, and only for its batch.
    """
    return _taken_apart(pages, judged_batches(pages, answers))


# Added to the instructions of a batch that is asked again.
AGAIN = "The answer before this one could not be used. Return JSON only, with exactly one entry for every page of the input."


def extracted_with_repair(pages: DataFrame, ask: Callable[[DataFrame], DataFrame], instructions: str, attempts: int = 3, order: str = "page_id") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(raw records, one error per page of batches that never held, report per attempt: ``attempt``, ``asked``, ``usable``).

    ``ask`` takes requests (batch, prompt, attempt) and gives answers (batch, answer, error). Batches whose answer fails
    any check, not only those that are no JSON, are asked again with altered instructions, up to ``attempts`` times;
    others are not. Answers are stored after each attempt, so a lost executor asks nothing twice.
    """
    if attempts < 1:
        raise ValueError("at least one attempt")
    pages, todo, kept, report = stored(pages, "extraction-pages"), None, None, []
    for n in range(1, attempts + 1):
        open_ = pages if todo is None else pages.join(todo, "batch", "left_semi")
        requests = extraction_requests(open_, instructions if n == 1 else f"{instructions.strip()}\n\n{AGAIN}", order).withColumn("attempt", F.lit(n))
        judged = stored(judged_batches(open_, stored(ask(requests), f"answers-{n}")), f"judged-{n}")
        usable = judged.where("error is null")
        kept = usable if kept is None else kept.unionByName(usable)
        todo = judged.where("error is not null").select("batch")
        report.append(judged.agg(F.lit(n).alias("attempt"), F.count("*").alias("asked"), F.count_if(F.col("error").isNull()).alias("usable")))
        if todo.isEmpty():
            break
    raw, errors = _taken_apart(pages, kept.unionByName(judged.where("error is not null")))
    return raw, errors, reduce(lambda a, b: a.unionByName(b), report)


def page_requests(pages: DataFrame, instructions: str, key: str = "url") -> DataFrame:
    """One request per page."""
    return pages.select(key, json_prompt(instructions, payload("page")).alias("prompt"))


def extracted_singly(pages: DataFrame, answers: DataFrame, key: str = "url") -> tuple[DataFrame, DataFrame]:
    """(raw records of the jobs in the answers with the page's ``key``, errors); an answer is one page's context and jobs.

    A page that answers with another page's ``page_id`` fails; one that names none is taken at its place.
    """
    fits = F.col("value.jobs").isNotNull() & F.coalesce(F.col("value.page_id") == F.col(f"_{key}"), F.lit(True))
    judged = _judged(pages, answers.withColumn(f"_{key}", F.col(key).cast("string")), key, schemas.EXTRACTION, fits)
    good = judged.where("error is null").withColumns({"page_context": F.col("value.page_context"), "jobs": F.col("value.jobs")}).drop("value", "error")
    raw = merged_context(good.withColumn("_key", F.col(key)), keep=("_key", "ord") if "ord" in pages.columns else ("_key",))
    return raw.withColumnRenamed("_key", f"page_{key}"), errors_of(judged, "job_extraction", key)


# Understanding and match.


def understanding_requests(jobs: DataFrame, instructions: str, key: str = "deduplication_key") -> DataFrame:
    """What jobs that passed the gate ask for; the others are asked nothing."""
    return jobs.where("not hard_reject").select(key, json_prompt(instructions, F.concat(F.lit('{"job":'), payload("job"), F.lit("}")), schemas.UNDERSTANDING).alias("prompt"))


def understood(jobs: DataFrame, answers: DataFrame, key: str = "deduplication_key") -> tuple[DataFrame, DataFrame]:
    """(key and ``understanding`` of jobs, errors). A job that did not pass the gate is an error, whatever was answered."""
    fits = F.col("value.canonical_role").isNotNull() & F.col("value.confidence").isin(*CONFIDENCES) & F.coalesce("value.seniority", F.lit("unclear")).isin(*SENIORITIES)
    judged = _judged(jobs, answers, key, schemas.UNDERSTANDING, fits)
    judged = judged.withColumn("error", F.when(F.col("hard_reject"), "Job understanding received a job that did not pass Basic Gate.").otherwise(F.col("error")))
    return judged.where("error is null").select(key, F.col("value").alias("understanding")), errors_of(judged, "job_understanding", key, "company_name", "title")


def match_requests(found: DataFrame, profile: Column, instructions: str, key: str = "deduplication_key") -> DataFrame:
    """What jobs beside their understanding and the profile ask for; hard rejects are asked nothing."""
    body = F.concat(F.lit('{"candidate_profile":'), F.to_json(profile), F.lit(',"job":'), payload("job"), F.lit(',"job_understanding":'), F.to_json("understanding", {"ignoreNullFields": "false"}), F.lit("}"))
    return found.where("not hard_reject").select(key, json_prompt(instructions, body, VERDICT).alias("prompt"))


def matched(records: DataFrame, jobs: DataFrame, answers: DataFrame, key: str = "deduplication_key", order: str = "ord", weights: dict[str, int] | None = None) -> tuple[DataFrame, DataFrame]:
    """(final assessments of understood jobs, errors).

    ``records``: key and ``understanding``; of several ``jobs`` with a key the last counts. A record without a job is an
    error; a hard reject is settled without an answer; any other needs one that fits.
    """
    none = F.array().cast("array<string>")
    held = records.select(key, "understanding").join(last_wins(jobs, [key], order).drop("position").withColumn("_job", F.lit(True)), key, "left")
    fits = F.col("value.role_fit").isin(*ROLE_FITS) & F.col("value.must_have_fit").isin(*MUST_HAVE_FITS) & F.col("value.confidence").isin(*CONFIDENCES)
    judged = _judged(held, answers, key, VERDICT, fits)
    judged = judged.withColumn("error", F.when(F.col("_job").isNull(), "Prepared job was not found.").when(~F.col("hard_reject"), F.col("error")))
    v = lambda c: F.when(~F.col("hard_reject"), F.col(f"value.{c}"))
    rows = judged.where("error is null").withColumns({
        "role_fit": v("role_fit"), "must_have": v("must_have_fit"), "confidence": v("confidence"), "understood_confidence": F.col("understanding.confidence"),
        "reasons": F.coalesce(v("match_reasons"), none), "flags": F.coalesce(v("risk_flags"), none), "missing_requirements": F.coalesce(v("missing_requirements"), none),
    })
    return assess(rows, weights).drop("value", "error", "_job"), errors_of(judged, "match_analysis", key, "company_name", "title")
