"""Text of pages and records as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Whole lines that are page furniture.
CHROME_LINES = (
    "cookie settings", "accept cookies", "privacy policy", "terms of use",
    "隐私政策", "隐私声明", "用户协议", "使用条款", "服务条款", "接受全部cookie", "接受所有cookie", "cookie设置",
)
# Headings from which an excerpt takes its blocks.
EXCERPT_MARKERS = ("职位介绍", "岗位职责", "工作职责", "岗位要求", "任职要求", "responsibilities", "requirements", "qualifications", "job description")

#: Everything that Python's splitlines() takes for a line's end.
LINE_ENDS = "\r\n|[\n\r\u000b\u000c\u001c\u001d\u001e\u0085  ]"


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that it names several times but that is worked out once."""
    return F.transform(F.array(value), use)[0]


def collapse(text: Column) -> Column:
    """Runs of white space, also beyond ASCII, to one space; trimmed; null to empty."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "(?U)\\s+", " "))


def blank_to_null(text: Column) -> Column:
    return F.nullif(collapse(text), F.lit(""))


def lines(text: Column) -> Column:
    """Lines without a last empty one."""
    parts = F.split(F.coalesce(text, F.lit("")), LINE_ENDS)
    return F.when(F.element_at(parts, -1) == "", F.slice(parts, F.lit(1), F.size(parts) - 1)).otherwise(parts)


def key_part(text: Column) -> Column:
    """Lower-case letters, digits and ideographs; anything else is a space. (``lower`` stands for case folding: ß stays.)"""
    return F.trim(F.regexp_replace(F.lower(collapse(text)), "[^a-z0-9一-鿿]+", " "))


def contained(text: Column, words: tuple[str, ...]) -> Column:
    """Those of ``words``, in their order, that ``text`` holds."""
    return F.filter(F.array(*map(F.lit, words)), lambda w: F.contains(text, w))


def distinct_filled(items: Column) -> Column:
    """First occurrences in order, blanks left out."""
    return F.array_distinct(F.filter(items, lambda x: F.coalesce(F.length(x) > 0, F.lit(False))))


def split_items(text: Column) -> Column:
    """Items between commas, semicolons and line ends, collapsed; the first of those that differ in case only."""
    items = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "[,;\n，；]"), collapse), lambda x: x != "")
    folded = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def all_reasons(*pairs: tuple[Column, Column | str]) -> Column:
    """The texts whose conditions hold, in order."""
    return F.array_compact(F.array(*(F.when(c, t if isinstance(t, Column) else F.lit(t)) for c, t in pairs)))


def merged_items(*groups: Column) -> Column:
    """Items of several lists in order; of those that differ in case only the first."""
    items = F.concat(*(F.coalesce(g, F.array().cast("array<string>")) for g in groups))
    folded = F.transform(items, F.lower)
    return F.filter(items, lambda x, i: F.array_position(folded, F.lower(x)) == i + 1)


def valid_run_id(text: Column) -> Column:
    """Whether a name can be a run's: a letter or digit, then up to 127 of them, dots, colons, dashes, underscores."""
    return F.coalesce(text.rlike("\\A[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}\\z"), F.lit(False))
