"""Education levels named in free text."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import bound

# Levels in rising order with the phrases that name them.
LEVELS = {
    "high_school": ("高中", "高中学历", "中专", "中等专业学校", "职高", "职业高中", "中职", "中等职业学校", "技校", "技工学校", "high school", "high school diploma", "secondary school"),
    "associate": ("专科", "专科学历", "大学专科", "大专", "大专学历", "associate degree", "associate's degree"),
    "bachelor": ("本科", "本科学历", "大学本科", "本科生", "学士", "学士学位", "bachelor", "bachelor's degree", "bachelors degree", "undergraduate", "undergraduate degree"),
    "master": ("硕士", "硕士学历", "硕士研究生", "硕士学位", "研究生", "研究生学历", "master", "master's degree", "masters degree", "postgraduate"),
    "doctorate": ("博士", "博士学历", "博士研究生", "博士学位", "doctorate", "doctoral", "doctoral degree", "phd", "ph.d"),
}
NAMES = tuple(LEVELS)


def _pattern(phrases: tuple[str, ...]) -> str:
    """Ideographs match anywhere, Latin phrases as whole words."""
    forms = []
    for p in phrases:
        q = re.sub(r"[._-]+", " ", p)
        forms.append(q if re.search("[一-鿿]", q) else f"(?<![a-z0-9]){re.escape(q).replace(chr(92) + ' ', ' ')}(?![a-z0-9])")
    return "|".join(forms)


def level_rank(text: Column) -> Column:
    """1 (high school) to 5 (doctorate): the lowest level named, as that is the minimum asked for; null if none is."""
    def rank(plain: Column) -> Column:
        out = F.lit(None).cast("int")
        for k in range(len(NAMES), 0, -1):
            out = F.when(plain.rlike(_pattern(LEVELS[NAMES[k - 1]])), k).otherwise(out)
        return out

    return bound(F.regexp_replace(F.lower(F.trim(F.regexp_replace(text, "(?U)\\s+", " "))), "[._-]+", " "), rank)


def level_name(rank: Column) -> Column:
    return F.get(F.array(*map(F.lit, NAMES)), rank - 1)


def levels(values: Column) -> Column:
    """Distinct known levels of ``values`` in order of first mention."""
    return F.array_distinct(F.array_compact(F.transform(values, lambda v: level_name(level_rank(v)))))


#: Distinct lists up to so many are broadcast; a table with more of them is ranked row by row.
MOST_LISTS = 100_000


def with_ranks(rows: DataFrame, levels: str = "education_levels", ranks: str = "education_ranks", most: int = MOST_LISTS) -> DataFrame:
    """``rows`` with the ranks of their texts of levels (see :func:`level_rank`; texts that name none are left out).

    Texts of a kind come again and again, and each is judged by a dozen patterns, so distinct lists are ranked once and
    joined back. Where there are more than ``most`` of them, each row's own list is ranked. A null list stays null.
    """
    ranked = F.array_compact(F.transform(levels, level_rank)).alias(ranks)
    lists = rows.where(F.col(levels).isNotNull()).select(levels).distinct()
    if lists.limit(most + 1).count() > most:
        return rows.select("*", ranked)
    return rows.join(F.broadcast(lists.select(F.col(levels).alias("_levels"), ranked)), F.col(levels) == F.col("_levels"), "left").drop("_levels")
