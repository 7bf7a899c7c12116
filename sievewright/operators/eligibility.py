"""The basic gate, match scores and final assessments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cohort_year, iso_date, year_month
from ..functions.education import NAMES, level_name, level_rank
from ..functions.text import all_reasons, distinct_filled

# Words of an explicit graduation requirement; weights of the score's parts; values of verdicts.
GRADUATION_WORDS = "graduat|degree completion|expected completion|cohort|毕业|应届"
WEIGHTS = {"role_alignment": 35, "requirement_fit": 25, "eligibility": 20, "location_preference": 10}
ROLE_FIT = {"high": 100, "medium": 65, "low": 20, "unclear": 40}
MUST_HAVE = {"yes": 100, "partial": 60, "no": 20, "unclear": 40}
BUCKETS = ((70, "apply"), (40, "consider"), (20, "low_priority"))


def mapped(value: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(value == k, v).otherwise(out)
    return out


def within(value: Column, start: Column, end: Column) -> Column:
    """Inclusive range, either end open if null."""
    return (start.isNull() | (value >= start)) & (end.isNull() | (value <= end))


def basic_gate(jobs: DataFrame, as_of: Column) -> DataFrame:
    """``jobs`` joined with a profile, with ``decision``, ``flag`` (of the first hard rule broken), ``risk_flags``, ``gate_reasons``, ``missing_requirements`` and ``recommendation_override``.

    Job columns: deadline, graduation_years, graduation_start, graduation_end, graduation_requirement, education_levels,
    locations; profile columns: p_graduation, p_education, p_excluded (canonical locations). Rules stand in order:
    deadline, window, year, education, location. Flags may repeat, and repeats count. ``p_education_rank``, if there is
    one, saves ranking the same profile again for each job, ``education_ranks`` (:func:`sievewright.functions.education.with_ranks`)
    ranking the same levels.
    """
    own = F.col("p_education_rank") if "p_education_rank" in jobs.columns else level_rank(F.col("p_education"))
    needs = F.col("education_ranks") if "education_ranks" in jobs.columns else F.array_compact(F.transform("education_levels", level_rank))
    rows = jobs.withColumns({"_needed": needs, "_own": own, "_due": iso_date(F.col("deadline"))})
    deadline, due = F.col("deadline"), F.col("_due")
    has_deadline = F.coalesce(deadline != "", F.lit(False))
    month, year = year_month(F.col("p_graduation")), cohort_year(F.col("p_graduation")).cast("string")
    start, end = year_month(F.col("graduation_start")), year_month(F.col("graduation_end"))
    window = start.isNotNull() | end.isNotNull()
    filled = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    asked = F.col("graduation_years")
    some_years, texts = F.size(asked) > 0, filled("graduation_start") | filled("graduation_end") | filled("graduation_requirement")
    years = F.filter(asked, lambda y: F.trim(y).rlike("^(19|20)\\d{2}$"))
    explicit = F.coalesce(F.lower("graduation_requirement").rlike(GRADUATION_WORDS), F.lit(False))
    misses = year.isNotNull() & (F.size(years) > 0) & ~F.array_contains(years, F.coalesce(year, F.lit("")))
    needed, own = F.col("_needed"), F.col("_own")
    low_education = (F.size(needed) > 0) & own.isNotNull() & ~F.exists(needed, lambda r: own >= r)
    bare = lambda c: F.transform(c, lambda x: F.lower(F.regexp_replace(x, "\\s+", "")))
    hits = F.array_intersect(bare("p_excluded"), bare("locations"))
    excluded = (F.size("locations") > 0) & (F.size(hits) > 0) & (F.size(hits) == F.size("locations"))
    hard = (
        F.when(has_deadline & due.isNotNull() & (due < as_of), "expired_deadline")
        .when(window & month.isNotNull() & ~within(month, start, end), "graduation_window_mismatch")
        .when(misses & explicit, "graduation_year_mismatch").when(low_education, "education_level_mismatch").when(excluded, "excluded_location")
    )
    unknown = "graduation_requirement_unknown"
    soft = all_reasons(
        (has_deadline & due.isNull(), F.concat(F.lit("invalid_deadline_format: "), deadline)),
        (~has_deadline, "deadline_unknown"),
        (~some_years & ~texts, unknown),
        (~some_years & texts & ~window, unknown),
        (window & month.isNull(), unknown),
        (some_years & (F.size(years) == 0), unknown),
        (misses & ~explicit, F.concat(F.lit("ambiguous_graduation_year_mismatch: candidate "), year)),
        ((F.size(years) > 0) & year.isNull(), unknown),
        (F.size(needed) == 0, "education_requirement_unknown"),
        ((F.size(needed) > 0) & own.isNull(), "education_candidate_unknown"),
        (F.size("locations") == 0, "location_unknown"),
    )
    told = {  # per hard rule: why, and what is missing
        "expired_deadline": ("Application deadline has passed.", F.concat(F.lit("Deadline "), deadline, F.lit(" is before "), as_of.cast("string"), F.lit("."))),
        "graduation_window_mismatch": ("Graduation eligibility window does not match.", F.concat(F.lit("Candidate graduation date "), "p_graduation", F.lit(" is outside required window."))),
        "graduation_year_mismatch": ("Graduation year eligibility does not match.", F.concat(F.lit("Candidate graduation year "), year, F.lit(" is not in required years: "), F.array_join(F.array_sort(F.array_distinct(F.transform(years, lambda x: F.trim(x)))), ", "), F.lit("."))),
        "education_level_mismatch": ("Explicit education-level requirement does not match.", F.concat(F.lit("Required education level: "), F.array_join(F.array_sort(F.array_distinct(F.transform(needed, level_name))), ", "), F.lit("."))),
        "excluded_location": ("Job location is explicitly excluded by the candidate profile.", F.concat(F.lit("Excluded location matched: "), F.array_join(F.array_sort(F.filter(F.array_distinct("p_excluded"), lambda x: F.array_contains(hits, F.lower(F.regexp_replace(x, "\\s+", ""))))), ", "), F.lit("."))),
    }
    judged = rows.withColumn("_hard", hard).withColumn("_soft", soft)
    broken, none = F.col("_hard").isNotNull(), F.array().cast("array<string>")
    said = lambda k: F.when(broken, F.array(mapped(F.col("_hard"), {f: F.lit(t[k]) if k == 0 else t[k] for f, t in told.items()}))).otherwise(none)
    return judged.select(
        *jobs.columns, F.when(broken, "skip").otherwise("pass").alias("decision"), F.col("_hard").alias("flag"), F.when(broken, F.array("_hard")).otherwise(F.col("_soft")).alias("risk_flags"),
        said(0).alias("gate_reasons"), said(1).alias("missing_requirements"), F.when(broken, "skip").alias("recommendation_override"),
    )


def components(role_fit: Column, must_have: Column, flags: Column, rejected: Column, locations: Column, preferred: Column) -> dict[str, Column]:
    near = (F.size(preferred) > 0) & (F.size(locations) > 0) & F.arrays_overlap(preferred, locations)
    return {
        "role_alignment": mapped(role_fit, ROLE_FIT).cast("int"),
        "requirement_fit": mapped(must_have, MUST_HAVE).cast("int"),
        "eligibility": F.when(rejected, 0).otherwise(F.greatest(F.lit(0), F.lit(100) - F.lit(10) * F.size(flags))),
        "location_preference": F.when(near, 100).otherwise(50),
    }


def weighted_score(parts: dict[str, Column], weights: dict[str, int] | None = None, cap: Column | None = None) -> Column:
    """Weighted mean by floor division, between 0 and 100; ``cap`` bounds it where it is not null."""
    weights = weights or WEIGHTS
    total = sum((parts[k].cast("long") * w for k, w in weights.items()), F.lit(0).cast("long"))
    score = F.greatest(F.lit(0), F.least(F.lit(100), F.call_function("div", total, F.lit(sum(weights.values())).cast("long")).cast("int")))
    return score if cap is None else F.least(score, F.coalesce(cap, score))


def bucket(score: Column) -> Column:
    out = F.lit("skip")
    for least, name in reversed(BUCKETS):
        out = F.when(score >= least, name).otherwise(out)
    return out


def final_confidence(semantic: Column, understood: Column, flags: Column) -> Column:
    """The lower of the two; high becomes medium where the gate has doubts."""
    rank = lambda c: mapped(c, {"low": 0, "medium": 1, "high": 2})
    low = F.least(rank(semantic), F.coalesce(rank(understood), rank(semantic)))
    return F.when(low == 0, "low").when((low == 1) | (F.size(flags) > 0), "medium").otherwise("high")


def assess(rows: DataFrame, weights: dict[str, int] | None = None) -> DataFrame:
    """Final assessments.

    Columns read: hard_reject, gate_reasons, gate_flags, locations, preferred, is_official, role_fit, must_have,
    confidence, understood_confidence, reasons, flags; where they exist also missing_requirements (of the verdict),
    gate_missing, recommendation_override and score_cap. A hard reject or a missing verdict (role_fit null) is settled
    without a score: fits are unclear, and only eligibility counts as a component, with 0.
    """
    none = F.array().cast("array<string>")
    given = lambda name, otherwise: F.col(name) if name in rows.columns else otherwise
    settled = F.col("hard_reject") | F.col("role_fit").isNull()
    parts = components(F.col("role_fit"), F.col("must_have"), F.col("gate_flags"), F.col("hard_reject"), F.col("locations"), F.col("preferred"))
    score = F.when(settled, 0).otherwise(weighted_score(parts, weights, given("score_cap", None)))
    override, missing = given("recommendation_override", F.lit(None).cast("string")), given("gate_missing", none)
    official = F.when(~F.col("is_official"), F.array(F.lit("non_official_source"))).otherwise(none)
    flags = F.when(settled, F.concat("gate_flags", official)).otherwise(F.concat("gate_flags", "flags", official))
    named = F.create_map(*(x for k, v in parts.items() for x in (F.lit(k), v.cast("int"))))
    return rows.withColumns({
        "match_score": score,
        "recommendation": F.coalesce(override, F.when(settled, "skip").otherwise(bucket(score))),
        "role_fit": F.when(settled, "unclear").otherwise(F.col("role_fit")),
        "must_have_fit": F.when(F.col("hard_reject"), "no").when(settled, "unclear").otherwise(F.col("must_have")),
        "final_confidence": F.when(settled, "high").otherwise(final_confidence(F.col("confidence"), F.col("understood_confidence"), F.col("gate_flags"))),
        "match_reasons": distinct_filled(F.when(settled, F.col("gate_reasons")).otherwise(F.concat("gate_reasons", "reasons"))),
        "missing_requirements": distinct_filled(F.when(settled, missing).otherwise(F.concat(missing, given("missing_requirements", none)))),
        "risk_flags": distinct_filled(flags),
        "deterministic_reasons": F.col("gate_reasons"),
        "score_components": F.when(settled, F.create_map(F.lit("eligibility"), F.lit(0))).otherwise(named),
        "analysis_source": F.when(settled, "deterministic_only").otherwise("semantic_with_program_scoring"),
    })


# Words of requirement facts that the gate has judged already, by what must be known for them.
COVERED = {
    "graduation_known": "graduat|cohort|class of|completion year",
    "education_known": "degree|bachelor|master|phd|doctorate|diploma|education level",
    "deadline_known": "deadline|apply by|application close|applications close",
    "location_known": "location|remote|hybrid|on-site|onsite|relocate|work from",
}


def uncovered_facts(facts: Column, known: dict[str, Column]) -> Column:
    """Facts (text) without those that speak of an input the gate knows; words match at their start."""
    def speaks(text: Column, words: str) -> Column:
        return F.lower(text).rlike("|".join(f"\\b{w}" for w in words.split("|")))

    return F.filter(facts, lambda f: ~sum(((known[k] & speaks(f, w)).cast("int") for k, w in COVERED.items()), F.lit(0)).cast("boolean"))


def required_level(texts: Column) -> Column:
    """The lowest level that any text asks for."""
    return level_name(F.array_min(F.transform(texts, level_rank)))


__all__ = ["NAMES", "assess", "basic_gate", "bucket", "components", "final_confidence", "required_level", "uncovered_facts", "weighted_score", "within"]
