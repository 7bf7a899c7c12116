"""Search queries from a profile: a rotation of roles, places, company kinds and signals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.dates import cohort_terms, cohort_year

# What stands in for missing preferences, and the signals a round turns through.
DEFAULT_PLACE, DEFAULT_KIND, DEFAULT_ROLE, DEFAULT_COHORT = "Australia", "employer", "graduate", "graduate"
SIGNALS = ("careers apply", "job description requirements", "graduate program")


def turned(items, at):
    """The item at a place that wraps around."""
    return F.get(items, F.pmod(at, F.size(items)))


def search_queries(profiles: DataFrame, executed: DataFrame, most: int = 6) -> DataFrame:
    """Rows (profile, idx, query) of ``profiles`` (profile, round, graduation, roles, places, kinds).

    ``executed`` holds (profile, query) of earlier rounds; comparison ignores case. Where nothing new is left, one role
    is asked for again with the next signal.
    """
    given = lambda c, default: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(default)))
    signals = F.array(*map(F.lit, SIGNALS))
    year = cohort_year(F.col("graduation"))
    base = profiles.select(
        "profile", "round", F.size("roles").alias("_roles"), given("roles", DEFAULT_ROLE).alias("roles"), given("places", DEFAULT_PLACE).alias("places"), given("kinds", DEFAULT_KIND).alias("kinds"),
        F.when(year.isNotNull(), turned(cohort_terms(year), F.col("round"))).otherwise(F.lit(DEFAULT_COHORT)).alias("cohort"),
    )
    at = F.col("round") + F.col("idx")
    rows = base.select("*", F.posexplode("roles").alias("idx", "role"))
    rows = rows.select("profile", "idx", F.concat(F.lit('"'), "role", F.lit('" '), "cohort", F.lit(" "), turned(F.col("places"), at), F.lit(" "), turned(F.col("kinds"), at), F.lit(" "), turned(signals, at)).alias("query"))
    again = base.where("_roles > 0").select("profile", F.lit(1_000_000).alias("idx"), F.concat(F.lit('"'), turned(F.col("roles"), F.col("round")), F.lit('" '), "cohort", F.lit(" "), turned(F.col("places"), F.col("round")), F.lit(" "), turned(signals, F.col("round") + 1)).alias("query"))
    done = executed.select("profile", F.lower(F.trim("query")).alias("_q")).distinct()
    fresh = lambda df: df.withColumn("_q", F.lower("query")).join(done, ["profile", "_q"], "left_anti").drop("_q")
    new = fresh(rows)
    spare = fresh(again).join(new.select("profile").distinct(), "profile", "left_anti")
    listed = new.unionByName(spare).groupBy("profile").agg(F.slice(F.array_sort(F.collect_list(F.struct("idx", "query"))), 1, most).alias("_l"))
    return listed.select("profile", F.posexplode("_l").alias("idx", "_x")).select("profile", "idx", F.col("_x.query").alias("query"))
