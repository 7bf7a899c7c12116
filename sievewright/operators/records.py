"""Job records: validation, normalisation, best of equals, grouping, keyed unions, upsert."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.dates import graduation_years, iso_date, normalize_date_text
from ..functions.education import levels
from ..functions.text import all_reasons, blank_to_null, key_part, lines

# Schemes of addresses that records may come from, and states a user may set.
SCHEMES = ("http", "https", "file", "mock")
STATUSES = ("未查看", "感兴趣", "准备投递", "已投递", "笔试", "一面", "二面", "Offer", "拒绝", "放弃", "已过期")
#: Fields whose presence makes a record the better of two.
FACTS = ("locations", "description", "requirements", "recruitment_type", "graduation_years", "graduation_start", "graduation_end", "graduation_requirement", "education_levels", "deadline", "apply_url")


def absolute_url(url: Column) -> Column:
    scheme = F.regexp_extract(url, "^([a-z][a-z0-9+.-]*):", 1)
    return F.when(scheme == "file", url.rlike("^file:(//[^/?#]*)?/?[^?#]+")).otherwise(scheme.isin(*SCHEMES) & url.rlike("^[a-z]+://[^/?#]+"))


def validation_reasons(title: Column, source_url: Column, deadline: Column) -> Column:
    """Why a record is invalid (empty: it is not). Nothing stops a batch."""
    filled = lambda c: F.coalesce(c != "", F.lit(False))
    return all_reasons(
        (F.coalesce(F.trim(title), F.lit("")) == "", "Missing required field(s): title"),
        (filled(source_url) & ~F.coalesce(absolute_url(source_url), F.lit(False)), "source_url must be a supported absolute URL"),
        (filled(deadline) & iso_date(deadline).isNull(), "deadline must be an ISO 8601 date"),
    )


def dedup_key(company: Column, title: Column, locations: Column, apply_url: Column, source_url: Column) -> Column:
    """Identity by address, else by facts. The scheme is part of an address."""
    filled = lambda u: F.nullif(key_part(u), F.lit(""))
    return F.coalesce(F.concat(F.lit("url|"), F.coalesce(filled(apply_url), filled(source_url))), F.concat_ws("|", F.lit("fallback"), key_part(company), key_part(title), key_part(F.array_join(locations, ","))))


def normalize_records(raw: DataFrame) -> DataFrame:
    """Fourteen fields to their normal forms, and the deduplication key. ``locations`` are expected to be canonical."""
    plain = ("company_name", "title", "company_type", "description", "requirements", "recruitment_type", "graduation_requirement", "source_name")
    dates = ("graduation_start", "graduation_end", "deadline")
    forms = {c: blank_to_null(F.col(c)) for c in plain} | {c: F.nullif(normalize_date_text(F.col(c)), F.lit("")) for c in dates}
    forms |= {"graduation_years": graduation_years(F.col("graduation_years")), "education_levels": levels(F.col("education_levels"))}
    key = dedup_key(F.col("company_name"), F.col("title"), F.col("locations"), F.col("apply_url"), F.col("source_url"))
    return raw.withColumns(forms).withColumn("deduplication_key", key)


def populated(columns: dict[str, bool] | list[str], array_columns: tuple[str, ...] = ()) -> Column:
    """How many of the columns are filled."""
    return reduce(lambda a, b: a + b, (F.coalesce((F.size(c) > 0) if c in array_columns else (F.col(c).cast("string") != ""), F.lit(False)).cast("int") for c in columns))


def best_of_equals(rows: DataFrame, key: str, order: str, *quality: Column) -> DataFrame:
    """``rows`` with ``best`` (the row that stays for its key) and ``position`` (first sight of the key).

    The highest quality wins, the earliest row among equals, so a later row replaces only if it is strictly better.
    """
    rank = Window.partitionBy(key).orderBy(*(q.desc() for q in quality), order)
    return rows.withColumn("best", F.row_number().over(rank) == 1).withColumn("position", F.min(order).over(Window.partitionBy(key)))


def preparation_counts(rows: DataFrame, reasons: str, key: str) -> DataFrame:
    """One row over judged records: input, valid, invalid, and of the valid ones unique and duplicate by ``key``."""
    valid = F.size(reasons) == 0
    keys = rows.groupBy(F.when(valid, F.col(key)).alias("_k"), valid.alias("_v")).agg(F.count("*").alias("_n"))
    n = lambda c, x: F.coalesce(F.sum(F.when(c, x)), F.lit(0))
    return keys.agg(
        F.coalesce(F.sum("_n"), F.lit(0)).alias("input_count"), n(F.col("_v"), F.col("_n")).alias("valid_count"), n(~F.col("_v"), F.col("_n")).alias("invalid_count"),
        F.count_if("_v").alias("unique_count"), n(F.col("_v"), F.col("_n") - 1).alias("duplicate_count"),
    )


def group_in_order(rows: DataFrame, by: str, order: str, item: Column, **extra: Column) -> DataFrame:
    """Groups with ``n`` and ``items`` in row order; null is a group of its own. ``extra`` adds aggregates."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), item.alias("v")))), lambda x: x["v"])
    return rows.groupBy(by).agg(F.count("*").alias("n"), listed.alias("items"), *(c.alias(k) for k, c in extra.items()))


def last_wins(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Per key its last row, at the position of its first."""
    rest = [c for c in rows.columns if c not in keys]
    held = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_last"), F.min(order).alias("position"))
    return held.select(*keys, *(F.col(f"_last.{c}").alias(c) for c in rest), "position")


def first_match(records: DataFrame, pages: DataFrame, record: str, url: str, page: str, addresses: Column, page_order: str) -> DataFrame:
    """``records`` with the first page one of whose addresses is theirs; null if none is."""
    named = pages.select(F.col(page), F.col(page_order).alias("_order"), F.explode(F.array_distinct(F.array_compact(addresses))).alias(url)).groupBy(url).agg(F.min_by(page, "_order").alias(page))
    return records.join(named, url, "left")


def either_backfill(records: DataFrame, pages: DataFrame, url: str, page_url: str, final_url: str, values: list[str], order: str = "ord") -> DataFrame:
    """Empty ``values`` of records from one page, whole: the last at their address, else the last that ended there.

    A record without such a page takes the only page where ``pages`` has just one row, and stays as it is otherwise.
    """
    page = F.struct(*values)

    def side(column: str, tag: str) -> DataFrame:
        return pages.where(F.col(column) != "").groupBy(F.col(column).alias(url)).agg(F.max_by(page, order).alias(tag))

    alone = pages.agg(F.when(F.count("*") == 1, F.first(page)).alias("_alone"))
    joined = records.join(side(page_url, "_a"), url, "left").join(side(final_url, "_b"), url, "left").crossJoin(F.broadcast(alone))
    told = joined.withColumn("_page", F.coalesce("_a", "_b", "_alone"))
    filled = {v: F.when(F.col("_page").isNull(), F.col(v)).otherwise(F.coalesce(F.nullif(v, F.lit("")), F.col("_page")[v])) for v in values}
    return told.withColumns(filled).select(*records.columns)


# What names an employer in a line of its own, what names none, and endings of company names.
COMPANY_LABEL = "(?i)^(?:company|employer|hiring company|organization|公司名称|招聘单位|用人单位|雇主)\\s*[:：]\\s*(.+?)\\s*$"
COMPANY_ABOUT = "(?i)^(?:about|关于)\\s+(.+?)\\s*$"
UNDISCLOSED = ("our client", "the client", "我们的客户", "客户公司", "匿名雇主")
COMPANY_ENDING = "(?i)(?:\\b(?:inc|corp|corporation|co\\.?|ltd|limited|llc|plc)\\.?$|有限公司$|集团$|科技$|银行$)"


def explicit_company(title: Column, text: Column) -> Column:
    """The employer that a page names itself; null if none does.

    Lines are judged in order, the title first: a labelled name, then an "about" heading, and in the title a part that
    ends like a company. Names that hide the employer do not count.
    """
    edge = lambda c, marks: F.regexp_replace(c, f"^[{marks}]+|[{marks}]+$", "")
    name = lambda c: edge(c, " .,:;，。：")
    told = lambda c: (c != "") & ~reduce(lambda x, y: x | y, (F.contains(F.lower(c), F.lit(m)) for m in UNDISCLOSED))
    rows = F.transform(F.concat(F.array(F.coalesce(title, F.lit(""))), lines(text)), lambda x: edge(F.regexp_replace(x, "(?U)^\\s+|\\s+$", ""), "|—–\\-"))

    def found(x: Column, at: Column) -> Column:
        parts = F.filter(F.transform(F.split(x, "(?U)\\s*[|｜—–]\\s*|\\s+-\\s+"), name), lambda c: told(c) & c.rlike(COMPANY_ENDING))
        named = F.array(*(F.when(x.rlike(form), name(F.regexp_extract(x, form, 1))) for form in (COMPANY_LABEL, COMPANY_ABOUT)))
        return F.get(F.concat(F.filter(F.array_compact(named), told), F.when(at == 0, parts).otherwise(F.array().cast("array<string>"))), F.lit(0))

    return F.get(F.array_compact(F.transform(rows, found)), F.lit(0))


def first_apply_url(links: Column) -> Column:
    """Address of the first link of kind apply."""
    return F.get(F.filter(links, lambda x: x["kind"] == "apply"), F.lit(0))["url"]


def merged_context(pages: DataFrame, context: str = "page_context", jobs: str = "jobs", keep: tuple[str, ...] = ()) -> DataFrame:
    """A raw record per extracted job: page context, what the page's source tells, and on top the job's own fields.

    ``pages``: url, source_name, source_company_name, company_type, source_location, is_official, title, visible_text,
    important_links, and the structs ``context`` and ``jobs``. Address, source and official state come from the source,
    never from the extraction; a company is the extraction's, else the page's own, else the source's; a job without
    places has its source's. A field that a job's struct holds replaces the context's, null too. ``keep`` names columns of
    the page that its records carry.
    """
    own = [f.name for f in pages.schema[jobs].dataType.elementType]
    given = [f.name for f in pages.schema[context].dataType]
    filled = lambda c: F.nullif(c, F.lit(""))
    host = F.lower(F.regexp_extract("url", "^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1))
    fields = {c: F.col(f"_page.{context}.{c}") for c in given} | {
        "company_name": F.coalesce(filled(F.col(f"_page.{context}.company_name") if "company_name" in given else F.lit(None).cast("string")), explicit_company(F.col("_page.title"), F.col("_page.visible_text")), F.col("_page.source_company_name")),
        "company_type": F.col("_page.company_type"), "apply_url": first_apply_url(F.col("_page.important_links")), "source_url": F.col("_page.url"),
        "source_name": F.coalesce(filled(F.col("_page.source_name")), F.col("_page._host")), "is_official": F.col("_page.is_official"),
    } | {c: F.col(f"_job.{c}") for c in own}
    if "locations" in fields:
        place = filled(F.col("_page.source_location"))
        fields["locations"] = F.when((F.coalesce(F.size(fields["locations"]), F.lit(0)) <= 0) & place.isNotNull(), F.array(place)).otherwise(fields["locations"])
    page = pages.withColumn("_host", host)
    rows = page.select(F.struct(*(c for c in page.columns if c != jobs)).alias("_page"), F.posexplode(jobs).alias("place", "_job"))
    return rows.select(*(v.alias(k) for k, v in fields.items()), "place", *(F.col(f"_page.{c}").alias(c) for c in keep))


# What each model is shown of a page or a record.
SHOWN = {"page": ("page_id", "title", "visible_text"), "job": ("title", "description", "requirements", "recruitment_type")}


def payload(kind: str) -> Column:
    """JSON of the fields that a model of ``kind`` is shown; nulls are written, so a reader sees every field."""
    return F.to_json(F.struct(*SHOWN[kind]), {"ignoreNullFields": "false"})


def packed(items: Column) -> Column:
    """A list as the text that a table without lists holds; null as an empty list."""
    return F.to_json(F.coalesce(items, F.array().cast("array<string>")))


def unpacked(text: Column) -> Column:
    """The list that :func:`packed` wrote; anything else is an empty list."""
    return F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))


# Fields a search cannot do without, and what to ask for them.
REQUIRED = (
    ("target_roles", "Add at least one target role."), ("skills", "Add at least one skill keyword."),
    ("graduation_date", "Add expected graduation year or date, for example 2026 or 2026-06."), ("preferred_locations", "Add at least one preferred location."),
)


def profile_gaps(profiles: DataFrame) -> DataFrame:
    """``profiles`` with ``missing_fields``, ``questions`` and ``is_complete``; a list counts if one of its items is not blank."""
    def lacks(name: str) -> Column:
        if name == "graduation_date":
            return ~F.coalesce(F.col(name).rlike("(19|20)\\d{2}"), F.lit(False))
        return F.coalesce(F.size(F.filter(name, lambda x: F.trim(x) != "")), F.lit(0)) <= 0

    told = profiles.withColumns({"missing_fields": all_reasons(*((lacks(n), n) for n, _ in REQUIRED)), "questions": all_reasons(*((lacks(n), q) for n, q in REQUIRED))})
    return told.withColumn("is_complete", F.size("missing_fields") == 0)


def company_order(jobs: DataFrame, company: str = "company_name") -> DataFrame:
    """Companies with their number of jobs, the most first, then by name whatever its case; jobs without one count as None's."""
    return jobs.groupBy(company).agg(F.count("*").alias("job_count")).orderBy(F.desc("job_count"), F.lower(F.coalesce(company, F.lit("None"))))


def company_view(jobs: DataFrame, order: str = "ord") -> DataFrame:
    """Jobs by company: count, whether any is official, first type known, distinct sources, the jobs themselves in order.

    Sources and jobs are listed per company, so a company's list is as long as its jobs are many.
    """
    n = F.col(order)
    first_seen = lambda c: F.array_distinct(F.transform(F.array_sort(F.collect_list(F.when(F.col(c) != "", F.struct(n.alias("o"), F.col(c).alias("v"))))), lambda x: x["v"]))
    held = F.struct(*(c for c in jobs.columns if c not in (order, "company_name", "company_type", "is_official")))
    return group_in_order(
        jobs, "company_name", order, held, is_official=F.bool_or("is_official"), company_type=F.min_by(F.nullif("company_type", F.lit("")), F.when(F.col("company_type") != "", n)),
        source_names=first_seen("source_name"), source_urls=first_seen("source_url"),
    ).withColumnsRenamed({"n": "job_count", "items": "jobs"})


# How a person's grid names the columns of jobs.
GRID = {"id": "id", "company_name": "company", "company_type": "company type", "title": "title", "locations": "locations", "status": "status", "notes": "notes", "source_url": "source url", "source_name": "source"}


def jobs_grid(jobs: DataFrame) -> DataFrame:
    return jobs.select(*(F.col(c).alias(n) for c, n in GRID.items()))


def score_rows(scored: DataFrame, *keys: str) -> DataFrame:
    """A row per component of each score."""
    return scored.select(*keys, F.explode("components").alias("component", "value"))


def flattened(rows: DataFrame, sep: str = ".") -> DataFrame:
    """Fields of structs as columns of their own, however deep, named by their path."""
    from pyspark.sql.types import StructType

    def leaves(kind, path):
        for f in kind:
            here = [*path, f.name]
            if isinstance(f.dataType, StructType):
                yield from leaves(f.dataType, here)
            else:
                yield here

    return rows.select(*(F.col(".".join(f"`{p}`" for p in path)).alias(sep.join(path)) for path in leaves(rows.schema, [])))


def fit_for_table(rows: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """(rows fit for the table, rows refused with ``reason``): a column that the table requires must not be null or blank."""
    lacks = all_reasons(*((F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == "", c) for c in required))
    judged = rows.withColumn("_lacks", lacks)
    refused = judged.where(F.size("_lacks") > 0).withColumn("reason", F.concat(F.lit("NOT NULL constraint failed: "), F.array_join("_lacks", ", "))).drop("_lacks")
    return judged.where(F.size("_lacks") == 0).drop("_lacks"), refused


def upsert_counted(old: DataFrame, new: DataFrame, key: str, preserved: list[str], required: list[str], order: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(the table after an upsert, rows refused with ``reason``, counts: inserted, updated, failed).

    A row without its key or a column that the table requires is refused and the others go in. Every other row of the
    batch counts: the first one of a new key as inserted, all others as updated.
    """
    good, refused = fit_for_table(new, list(dict.fromkeys([key, *required])))
    table = upsert(old, good, key, preserved, order=order)
    fresh = F.col("action") == "inserted"
    counts = table.agg(F.count_if(fresh).alias("inserted_count"), F.coalesce(F.sum(F.col("rows_seen") - fresh.cast("int")), F.lit(0)).alias("updated_count"))
    return table, refused, counts.crossJoin(F.broadcast(refused.agg(F.count("*").alias("failed_count"))))


def folded(batch: DataFrame, key: str, preserved: list[str], order: str | None = None) -> DataFrame:
    """A batch as one row per key, as if its rows went in one after another by ``order``.

    ``_last``: the facts of the last row, ``_first``: the ``preserved`` columns of the first, ``_at``: when that came,
    ``_rows``: how many there are. Without ``order`` rows follow each other by their values. Rows of a key are folded by
    partial aggregates, so a hot key reaches a reducer as one row per task.
    """
    facts = [c for c in batch.columns if c not in (key, order, *preserved)]
    place = F.col(order) if order else F.struct(key, *facts, *preserved)
    kept = F.struct(*preserved) if preserved else F.struct(F.lit(None).cast("string").alias("_none"))
    return batch.groupBy(key).agg(F.max_by(F.struct(*facts), place).alias("_last"), F.min_by(kept, place).alias("_first"), F.min(place).alias("_at"), F.count("*").alias("_rows"))


def upsert(old: DataFrame, new: DataFrame, key: str, preserved: list[str], id_col: str = "id", order: str | None = None) -> DataFrame:
    """The table after the rows of ``new`` went in one by one in the order of the column ``order``.

    Of a key that was there, id and ``preserved`` columns stay and the facts are those of its last row; of a new key the
    first row's ``preserved`` columns count and its last row's facts. New keys are numbered on from the largest id in the
    order they came in (without ``order``: of their keys), by ranges and their counts. ``action`` tells inserted, updated,
    unchanged, ``rows_seen`` how many rows of the batch had the key. ``order`` is no part of the table.
    """
    from ..plans.numbering import numbered

    facts = [c for c in new.columns if c not in (key, order, *preserved)]
    batch = folded(new, key, preserved, order)
    told, hit = old.join(batch, key, "left"), F.col("_rows").isNotNull()
    seen = F.coalesce("_rows", F.lit(0)).alias("rows_seen")
    held = told.select(
        id_col, key, *(F.when(hit, F.col(f"_last.{f}")).otherwise(F.col(f)).alias(f) if f in old.columns else F.col(f"_last.{f}").alias(f) for f in facts), *preserved,
        F.when(hit, "updated").otherwise("unchanged").alias("action"), seen,
    )
    fresh = batch.join(old.select(key), key, "left_anti")
    count = numbered(fresh, "_at") if order else numbered(fresh, key)
    top = old.agg(F.coalesce(F.max(id_col), F.lit(0)).alias("_top"))
    inserted = count.crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("row_no")).cast("long").alias(id_col), key, *(F.col(f"_last.{f}").alias(f) for f in facts), *(F.col(f"_first.{p}").alias(p) for p in preserved), F.lit("inserted").alias("action"), seen)
    return held.unionByName(inserted)


def set_status(jobs: DataFrame, job_id: int, status: str, notes: str) -> DataFrame:
    if status not in STATUSES:
        raise ValueError(f"unknown status: {status}")
    mine = F.col("id") == job_id
    return jobs.withColumns({"status": F.when(mine, status).otherwise(F.col("status")), "notes": F.when(mine, notes).otherwise(F.col("notes"))})


def migrated(legacy: DataFrame) -> DataFrame:
    """A table of the first layout in the present one: one location becomes a list, the key is made from the id."""
    return legacy.select("id", F.concat(F.lit("legacy|"), F.col("id").cast("string")).alias("deduplication_key"), "title", F.when(F.coalesce("location", F.lit("")) != "", F.array("location")).otherwise(F.array().cast("array<string>")).alias("locations"), F.lit(STATUSES[0]).alias("status"), F.lit("").alias("notes"))
