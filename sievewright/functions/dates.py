"""Dates kept as text of mixed precision, graduation years and cohorts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import collapse


def iso_date(text: Column) -> Column:
    """DATE of a strict yyyy-MM-dd or yyyyMMdd text, else null (Spark's own cast takes more)."""
    return F.when(text.rlike("^\\d{4}-\\d{2}-\\d{2}$"), F.try_to_date(text, "yyyy-MM-dd")).when(text.rlike("^\\d{8}$"), F.try_to_date(text, "yyyyMMdd"))


def normalize_date_text(text: Column) -> Column:
    """Dates and date-times to yyyy-MM-dd, months to yyyy-MM, other text as it is."""
    plain = collapse(text)
    dashed = F.translate(plain, "/.", "--")
    day = iso_date(dashed)
    stamped = F.when(dashed.rlike("^\\d{4}-\\d{2}-\\d{2}[T ]\\d{2}(:\\d{2}){0,2}"), iso_date(F.substring(dashed, 1, 10)))
    return F.when(day.isNotNull(), F.date_format(day, "yyyy-MM-dd")).when(stamped.isNotNull(), F.date_format(stamped, "yyyy-MM-dd")).when(dashed.rlike("^(19|20)\\d{2}-(0[1-9]|1[0-2])$"), dashed).otherwise(plain)


def graduation_years(values: Column) -> Column:
    """Distinct years 1900 to 2099 that stand alone in any value, ascending."""
    return F.array_sort(F.array_distinct(F.flatten(F.transform(values, lambda v: F.regexp_extract_all(F.coalesce(v, F.lit("")), F.lit("(?<!\\d)((?:19|20)\\d{2})(?!\\d)"), F.lit(1))))))


def year_month(text: Column) -> Column:
    """INT yyyyMM of yyyy, yyyy-MM or yyyy-MM-dd (a year alone counts as June), else null."""
    form = "^\\s*((?:19|20)\\d{2})(?:-(0[1-9]|1[0-2])(?:-\\d{2})?)?\\s*$"
    month = F.coalesce(F.nullif(F.regexp_extract(text, form, 2), F.lit("")), F.lit("06"))
    return F.when(text.rlike(form), F.concat(F.regexp_extract(text, form, 1), month).cast("int"))


def cohort_year(text: Column) -> Column:
    """The graduating class: the year, or the next one from September on."""
    dated = "(?<!\\d)((?:19|20)\\d{2})[-/.](0?[1-9]|1[0-2])(?!\\d)"
    alone = "(?<!\\d)((?:19|20)\\d{2})(?!\\d)"
    year = F.regexp_extract(text, dated, 1)
    return F.when(text.rlike(dated), year.cast("int") + (F.regexp_extract(text, dated, 2).cast("int") >= 9).cast("int")).when(text.rlike(alone), F.regexp_extract(text, alone, 1).cast("int"))


def cohort_terms(year: Column) -> Column:
    """Search terms of a class. The five forms."""
    y = year.cast("string")
    return F.array(F.concat(y, F.lit("届")), F.concat(y, F.lit("校招")), F.concat(y, F.lit("校园招聘")), F.concat(y, F.lit(" graduate")), F.concat(y, F.lit(" Graduate Program")))
