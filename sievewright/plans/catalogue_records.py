"""Queries over records: validation, normal forms, best of equals, joins, gates, scores, upserts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, education, locations, markup, text
from ..operators import eligibility, records
from ..session import ready, shared_folder, table
from ..sources import buckets
from .numbering import numbered
from .registry import registry

QUERIES, SQL, query = registry()
_NONE = "cast(null as string)"


def _jobs(spark, d):
    """Orders as postings: some without title, some with a bad address or date, dates in several spellings."""
    o = table(spark, d, "orders")
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return o.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") != "4-NOT SPECIFIED", F.concat(F.lit("  Role\t"), F.col("o_orderpriority"))).alias("title"),
        F.when(F.col("o_orderstatus") == "P", F.lit("ftp://x/y")).otherwise(F.concat(F.lit("https://jobs.example/"), F.col("o_custkey").cast("string"))).alias("source_url"),
        F.when(F.col("o_orderpriority") == "1-URGENT", F.translate(day, "-", "/")).when(F.col("o_orderpriority") == "5-LOW", F.expr(_NONE)).otherwise(day).alias("deadline"),
        F.when(F.col("o_orderstatus") == "F", F.lit("硕士及以上")).when(F.col("o_orderstatus") == "O", F.lit("Bachelor's degree or PhD")).otherwise(F.lit("none")).alias("education"),
        F.date_format("o_orderdate", "yyyy").alias("year"), F.col("o_custkey").alias("company"), F.col("o_totalprice").alias("price"),
    )


_JOBS = """
WITH jobs AS (SELECT o_orderkey AS id, CASE WHEN o_orderpriority <> '4-NOT SPECIFIED' THEN '  Role' || chr(9) || o_orderpriority END AS title,
 CASE WHEN o_orderstatus = 'P' THEN 'ftp://x/y' ELSE 'https://jobs.example/' || o_custkey END AS source_url,
 CASE WHEN o_orderpriority = '1-URGENT' THEN strftime(o_orderdate, '%Y/%m/%d') WHEN o_orderpriority = '5-LOW' THEN NULL ELSE strftime(o_orderdate, '%Y-%m-%d') END AS deadline,
 CASE o_orderstatus WHEN 'F' THEN 'master' WHEN 'O' THEN 'bachelor' END AS level, strftime(o_orderdate, '%Y') AS year, o_custkey AS company, o_totalprice AS price FROM orders)
"""


@query(_JOBS + """
SELECT id, array_to_string(list_filter([CASE WHEN title IS NULL THEN 'Missing required field(s): title' END, CASE WHEN source_url LIKE 'ftp%' THEN 'source_url must be a supported absolute URL' END,
 CASE WHEN deadline LIKE '%/%' THEN 'deadline must be an ISO 8601 date' END], lambda x: x IS NOT NULL), '; ') AS reasons FROM jobs
""")
def validate_records(spark, d):
    return _jobs(spark, d).select("id", F.array_join(records.validation_reasons(F.col("title"), F.col("source_url"), F.col("deadline")), "; ").alias("reasons"))


@query(_JOBS + "SELECT count(*) AS input, count(*) FILTER (title IS NOT NULL AND source_url NOT LIKE 'ftp%' AND coalesce(deadline, '') NOT LIKE '%/%') AS valid FROM jobs")
def validation_counts(spark, d):
    reasons = records.validation_reasons(F.col("title"), F.col("source_url"), F.col("deadline"))
    return _jobs(spark, d).agg(F.count("*").alias("input"), F.count_if(F.size(reasons) == 0).alias("valid"))


@query(_JOBS + """
SELECT id, trim(replace(title, chr(9), ' ')) AS title, replace(deadline, '/', '-') AS deadline, coalesce(level, '') AS levels, year AS years,
 'url|' || trim(regexp_replace(source_url, '[^a-z0-9]+', ' ', 'g')) AS deduplication_key FROM jobs
""")
def normalize_records(spark, d):
    raw = _jobs(spark, d).select("id", "title", "deadline", "source_url", F.array("education").alias("education_levels"), F.array(F.concat(F.lit("class of "), "year")).alias("graduation_years"), F.array().cast("array<string>").alias("locations"), *(F.expr(_NONE).alias(c) for c in ("company_name", "company_type", "description", "requirements", "recruitment_type", "graduation_requirement", "source_name", "graduation_start", "graduation_end", "apply_url")))
    n = records.normalize_records(raw)
    return n.select("id", "title", "deadline", F.array_join("education_levels", ",").alias("levels"), F.array_join("graduation_years", ",").alias("years"), "deduplication_key")


@query("SELECT o_orderkey AS id, CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END AS cohort, year(o_orderdate) * 100 + month(o_orderdate) AS month, CASE WHEN month(o_orderdate) >= 9 THEN year(o_orderdate) + 1 ELSE year(o_orderdate) END || ' graduate' AS term FROM orders")
def cohorts(spark, d):
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), dates.cohort_year(F.concat(F.lit("grad "), F.date_format("o_orderdate", "yyyy/M"))).alias("cohort"), dates.year_month(day).alias("month"), dates.cohort_terms(dates.cohort_year(day))[3].alias("term"))


@query("SELECT o_orderkey AS id, strftime(o_orderdate, '%Y-%m-%d') AS slashed, strftime(o_orderdate, '%Y-%m') AS dotted_month, strftime(o_orderdate, '%Y-%m-%d') AS stamped, 'soon ' || o_orderstatus AS other FROM orders")
def date_texts(spark, d):
    f = lambda p: dates.normalize_date_text(F.date_format("o_orderdate", p))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), f("yyyy/MM/dd").alias("slashed"), f("yyyy.MM").alias("dotted_month"), f("yyyy-MM-dd'T'HH:mm:ss").alias("stamped"), dates.normalize_date_text(F.concat(F.lit(" soon  "), "o_orderstatus")).alias("other"))


@query("""
WITH r AS (SELECT p_partkey, p_brand, p_type = 'PROMO' AS official, CASE WHEN p_size > 25 THEN 1 ELSE 0 END + CASE WHEN p_retailprice > 1000 THEN 1 ELSE 0 END AS filled FROM part)
SELECT p_partkey, p_brand, row_number() OVER (PARTITION BY p_brand ORDER BY official DESC, filled DESC, p_partkey) = 1 AS best, min(p_partkey) OVER (PARTITION BY p_brand) AS position FROM r
""")
def dedup_best(spark, d):
    p = table(spark, d, "part").withColumns({"description": F.when(F.col("p_size") > 25, "x"), "requirements": F.when(F.col("p_retailprice") > 1000, "y")})
    return records.best_of_equals(p, "p_brand", "p_partkey", F.col("p_type") == "PROMO", records.populated(["description", "requirements"])).select("p_partkey", "p_brand", "best", "position")


@query("""
SELECT n_name AS company, count(*) AS n, string_agg(s_name, ',' ORDER BY s_suppkey) AS names, bool_or(s_acctbal > 5000) AS official FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name
""")
def group_ordered(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    g = records.group_in_order(s.withColumnRenamed("n_name", "company"), "company", "s_suppkey", F.col("s_name"), official=F.bool_or(F.col("s_acctbal") > 5000))
    return g.select("company", "n", F.array_join("items", ",").alias("names"), "official")


@query("SELECT o_orderkey AS id, coalesce(c_name, 'Untitled') AS name, CASE WHEN c_custkey IS NULL THEN 'Prepared job was not found.' END AS error FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 0) ON o_custkey = c_custkey")
def lookup_join_errors(spark, d):
    jobs = table(spark, d, "customer").where("c_acctbal > 0").select("c_custkey", "c_name")
    j = table(spark, d, "orders").join(jobs, F.col("o_custkey") == F.col("c_custkey"), "left")
    return j.select(F.col("o_orderkey").alias("id"), F.coalesce("c_name", F.lit("Untitled")).alias("name"), F.when(F.col("c_custkey").isNull(), "Prepared job was not found.").alias("error"))


_BOTH = "(SELECT c_custkey AS url, c_custkey + 1 AS final_url, c_mktsegment AS segment, c_name AS name FROM customer)"
_HELD = "(SELECT c_custkey AS ord, CAST(c_custkey // 3 AS VARCHAR) AS url, CASE WHEN c_custkey % 4 > 0 THEN CAST(c_custkey // 2 + 300 AS VARCHAR) ELSE '' END AS final_url, CASE WHEN c_custkey % 7 = 0 THEN '' ELSE c_mktsegment END AS segment, CASE WHEN c_custkey % 5 > 0 THEN c_name END AS name FROM customer)"


@query(f"""
WITH a AS (SELECT url, max(ord) AS ord FROM {_HELD} GROUP BY url), b AS (SELECT final_url, max(ord) AS ord FROM {_HELD} WHERE final_url <> '' GROUP BY final_url),
r AS (SELECT o_orderkey AS id, CAST(o_custkey AS VARCHAR) AS url, CASE o_orderstatus WHEN 'F' THEN 'own' WHEN 'P' THEN '' END AS own FROM orders)
SELECT id, CASE WHEN own <> '' OR p.ord IS NULL THEN own ELSE p.segment END AS segment, CASE WHEN p.ord IS NULL THEN '' ELSE p.name END AS name
FROM r LEFT JOIN a ON a.url = r.url LEFT JOIN b ON b.final_url = r.url LEFT JOIN {_HELD} p ON p.ord = coalesce(a.ord, b.ord)
""")
def or_join_backfill(spark, d):
    """Three pages share an address and two a final one; pages have empty and null values of their own."""
    k = F.col("c_custkey")
    text = lambda e: F.expr(e).cast("string")
    pages = table(spark, d, "customer").select(k.alias("ord"), text("c_custkey div 3").alias("page_url"), F.when(k % 4 > 0, text("c_custkey div 2 + 300")).otherwise("").alias("final_url"), F.when(k % 7 == 0, "").otherwise(F.col("c_mktsegment")).alias("segment"), F.when(k % 5 > 0, F.col("c_name")).alias("name"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("url"), F.when(F.col("o_orderstatus") == "F", "own").when(F.col("o_orderstatus") == "P", "").alias("segment"), F.lit("").alias("name"))
    return records.either_backfill(rows, pages, "url", "page_url", "final_url", ["segment", "name"]).select("id", "segment", "name")


@query(f"""
WITH k AS (SELECT url AS u, url AS page FROM {_BOTH} UNION ALL SELECT final_url, url FROM {_BOTH}), f AS (SELECT u, min(page) AS page FROM k GROUP BY u)
SELECT o_orderkey AS id, page FROM orders LEFT JOIN f ON u = o_custkey
""")
def first_match(spark, d):
    pages = table(spark, d, "customer").select(F.col("c_custkey").alias("page"), F.col("c_custkey").alias("page_url"), (F.col("c_custkey") + 1).alias("final_url"))
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("url"))
    return records.first_match(rows, pages, "id", "url", "page", F.array("page_url", "final_url"), "page").select("id", "page")


@query("SELECT 'unknown' AS problem, count(*) AS n FROM (SELECT DISTINCT doc_id FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)) UNION ALL SELECT 'missing', count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels) UNION ALL SELECT 'repeated', count(*) FROM (SELECT doc_id FROM labels GROUP BY doc_id HAVING count(*) > 1)")
def answer_check(spark, d):
    """Answers against their questions: ids that were not asked, not answered, answered twice."""
    docs, labels = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.lit(name).alias("problem"), F.count("*").alias("n"))
    return n(labels.distinct().join(docs, "doc_id", "left_anti"), "unknown").unionByName(n(docs.join(labels, "doc_id", "left_anti"), "missing")).unionByName(n(labels.groupBy("doc_id").count().where("count > 1"), "repeated"))


@query("WITH x AS (SELECT conv_id, role, turn, text, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn DESC) AS rn, min(turn) OVER (PARTITION BY conv_id, role) AS position FROM conversations) SELECT conv_id, role, turn, text, position FROM x WHERE rn = 1")
def merge_last_wins(spark, d):
    return records.last_wins(table(spark, d, "conversations"), ["conv_id", "role"], "turn")


@query("SELECT user_id, array_to_string(list_sort(list_distinct(list(event_type))), ',') AS kinds FROM events GROUP BY user_id")
def union_distinct(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.array_join(F.array_sort(F.collect_set("event_type")), ",").alias("kinds"))


@query("SELECT 'difference' AS op, count(*) AS n FROM (SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels) UNION ALL SELECT 'both', count(*) FROM (SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels) UNION ALL SELECT 'either', count(*) FROM (SELECT doc_id FROM documents UNION SELECT doc_id FROM labels)")
def set_operations(spark, d):
    a, b = table(spark, d, "documents").select("doc_id"), table(spark, d, "labels").select("doc_id")
    n = lambda df, name: df.agg(F.lit(name).alias("op"), F.count("*").alias("n"))
    return n(a.subtract(b), "difference").unionByName(n(a.intersect(b), "both")).unionByName(n(a.union(b).distinct(), "either"))


_GATE = _JOBS + """
, g AS (SELECT id, CASE WHEN deadline IS NOT NULL AND deadline NOT LIKE '%/%' AND CAST(deadline AS DATE) < DATE '1997-01-01' THEN 'expired_deadline'
  WHEN CAST(substr(year, 1, 4) AS INT) * 100 + 6 > 199906 THEN 'graduation_window_mismatch' WHEN level = 'master' THEN 'education_level_mismatch' END AS flag,
 array_to_string(list_filter([CASE WHEN deadline LIKE '%/%' THEN 'invalid_deadline_format: ' || deadline END, CASE WHEN deadline IS NULL THEN 'deadline_unknown' END,
  CASE WHEN level IS NULL THEN 'education_requirement_unknown' END, 'location_unknown'], lambda x: x IS NOT NULL), ';') AS soft FROM jobs)
"""


def _gated(spark, d):
    j = _jobs(spark, d).select("id", "deadline", F.array().cast("array<string>").alias("graduation_years"), F.col("year").alias("graduation_start"), F.expr(_NONE).alias("graduation_end"), F.expr(_NONE).alias("graduation_requirement"), F.array("education").alias("education_levels"), F.array().cast("array<string>").alias("locations"))
    profile = spark.createDataFrame([("1999-06", "本科", ["上海"])], "p_graduation string, p_education string, p_excluded array<string>").withColumn("p_education_rank", education.level_rank(F.col("p_education")))
    return eligibility.basic_gate(education.with_ranks(j).crossJoin(F.broadcast(profile)), F.lit("1997-01-01").cast("date"))


@query(_GATE + """SELECT id, CASE WHEN flag IS NULL THEN 'pass' ELSE 'skip' END AS decision, flag, coalesce(flag, soft) AS risk_flags, CASE WHEN flag IS NOT NULL THEN 'skip' END AS override,
 CASE flag WHEN 'expired_deadline' THEN 'Application deadline has passed.' WHEN 'graduation_window_mismatch' THEN 'Graduation eligibility window does not match.' WHEN 'education_level_mismatch' THEN 'Explicit education-level requirement does not match.' ELSE '' END AS reasons,
 CASE flag WHEN 'expired_deadline' THEN 'Deadline ' || deadline || ' is before 1997-01-01.' WHEN 'graduation_window_mismatch' THEN 'Candidate graduation date 1999-06 is outside required window.' WHEN 'education_level_mismatch' THEN 'Required education level: master.' ELSE '' END AS missing
FROM g JOIN (SELECT id, deadline FROM jobs) USING (id)""")
def hard_gate(spark, d):
    return _gated(spark, d).select("id", "decision", "flag", F.array_join("risk_flags", ";").alias("risk_flags"), F.col("recommendation_override").alias("override"), F.array_join("gate_reasons", ";").alias("reasons"), F.array_join("missing_requirements", ";").alias("missing"))


@query("SELECT o_orderkey AS id, o_orderdate BETWEEN TIMESTAMP '1996-03-01' AND TIMESTAMP '1997-05-31' AS closed, o_orderdate >= TIMESTAMP '1996-03-01' AS open_end FROM orders")
def range_gate(spark, d):
    day, start, end = F.col("o_orderdate"), F.lit("1996-03-01").cast("timestamp"), F.lit("1997-05-31").cast("timestamp")
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), eligibility.within(day, start, end).alias("closed"), eligibility.within(day, start, F.lit(None).cast("timestamp")).alias("open_end"))


_SCORE = """
WITH c AS (SELECT c_custkey AS id, CASE c_mktsegment WHEN 'MACHINERY' THEN 100 WHEN 'BUILDING' THEN 65 WHEN 'AUTOMOBILE' THEN 20 ELSE 40 END AS r,
 CASE WHEN c_acctbal > 5000 THEN 100 WHEN c_acctbal > 2000 THEN 60 WHEN c_acctbal > 0 THEN 20 ELSE 40 END AS q, c_nationkey AS flags, CASE WHEN c_nationkey < 5 THEN 100 ELSE 50 END AS l FROM customer),
s AS (SELECT id, (35 * r + 25 * q + 20 * greatest(0, 100 - 10 * flags) + 10 * l) // 90 AS score FROM c)
"""


def _scored(spark, d):
    seg, bal, flags = F.col("c_mktsegment"), F.col("c_acctbal"), F.sequence(F.lit(1), F.col("c_nationkey"))
    role = F.when(seg == "MACHINERY", "high").when(seg == "BUILDING", "medium").when(seg == "AUTOMOBILE", "low").otherwise("unclear")
    must = F.when(bal > 5000, "yes").when(bal > 2000, "partial").when(bal > 0, "no").otherwise("unclear")
    many = F.when(F.col("c_nationkey") > 0, F.transform(flags, lambda x: x.cast("string"))).otherwise(F.array().cast("array<string>"))
    place = F.array(F.when(F.col("c_nationkey") < 5, "near").otherwise("far"))
    return table(spark, d, "customer").select(F.col("c_custkey").alias("id"), role.alias("role_fit"), must.alias("must_have"), many.alias("gate_flags"), place.alias("locations"), F.array(F.lit("near")).alias("preferred"), (F.col("c_nationkey") == 7).alias("hard_reject"), (bal > 0).alias("is_official"))


@query(_SCORE + "SELECT id, score, CASE WHEN score >= 70 THEN 'apply' WHEN score >= 40 THEN 'consider' WHEN score >= 20 THEN 'low_priority' ELSE 'skip' END AS recommendation FROM s")
def weighted_score(spark, d):
    c = _scored(spark, d)
    score = eligibility.weighted_score(eligibility.components(F.col("role_fit"), F.col("must_have"), F.col("gate_flags"), F.lit(False), F.col("locations"), F.col("preferred")))
    return c.select("id", score.alias("score")).withColumn("recommendation", eligibility.bucket(F.col("score")))


@query(_SCORE + """
, t AS (SELECT s.id, c_nationkey = 7 OR c_custkey % 11 = 0 AS settled, c_nationkey = 7 AS rejected, CASE WHEN c_custkey % 3 = 0 THEN least(score, 50) ELSE score END AS score, c_nationkey, c_acctbal, c_custkey FROM s JOIN customer ON s.id = c_custkey)
SELECT t.id, CASE WHEN settled THEN 0 ELSE score END AS match_score, CASE WHEN rejected OR settled THEN 'skip' WHEN score >= 70 THEN 'apply' WHEN score >= 40 THEN 'consider' WHEN score >= 20 THEN 'low_priority' ELSE 'skip' END AS recommendation,
 CASE WHEN settled THEN 'unclear' ELSE CASE r WHEN 100 THEN 'high' WHEN 65 THEN 'medium' WHEN 20 THEN 'low' ELSE 'unclear' END END AS role_fit,
 CASE WHEN settled THEN 'high' WHEN c_nationkey = 0 AND c_acctbal > 3000 THEN 'high' WHEN c_acctbal > -500 THEN 'medium' ELSE 'low' END AS confidence,
 array_to_string(list_concat(list_transform(range(1, c_nationkey + 1), lambda x: CAST(x AS VARCHAR)), CASE WHEN c_acctbal > 0 THEN [] ELSE ['non_official_source'] END), ',') AS flags,
 CASE WHEN rejected THEN 'no way' WHEN settled THEN '' ELSE 'a degree' END AS missing, CASE WHEN settled THEN 'eligibility=0' ELSE 'role_alignment=' || r || ',requirement_fit=' || q || ',eligibility=' || greatest(0, 100 - 10 * c_nationkey) || ',location_preference=' || l END AS components
FROM t JOIN c ON t.id = c.id
""")
def final_assessment(spark, d):
    """Some jobs are rejected, some have no verdict, some scores are capped."""
    more = table(spark, d, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal", F.when(F.col("c_custkey") % 3 == 0, 50).alias("score_cap"), (F.col("c_custkey") % 11 == 0).alias("_none"))
    none, some = F.array().cast("array<string>"), lambda c, x: F.when(c, F.array(F.lit(x))).otherwise(F.array().cast("array<string>"))
    c = _scored(spark, d).join(more, "id").withColumn("role_fit", F.when(~F.col("_none"), F.col("role_fit"))).withColumns({"gate_reasons": none, "reasons": none, "flags": none, "confidence": F.when(F.col("c_acctbal") > 3000, "high").when(F.col("c_acctbal") > -500, "medium").otherwise("low"), "understood_confidence": F.lit("high"), "gate_missing": some(F.col("hard_reject"), "no way"), "missing_requirements": F.array(F.lit("a degree")), "recommendation_override": F.when(F.col("hard_reject"), "skip")})
    parts = F.array_join(F.transform(F.map_entries("score_components"), lambda x: F.concat(x["key"], F.lit("="), x["value"].cast("string"))), ",")
    return eligibility.assess(c).select("id", "match_score", "recommendation", "role_fit", F.col("final_confidence").alias("confidence"), F.array_join("risk_flags", ",").alias("flags"), F.array_join("missing_requirements", ",").alias("missing"), parts.alias("components"))


@query("""
WITH old AS (SELECT c_custkey AS id, c_name AS key, c_acctbal AS fact, c_mktsegment AS status FROM customer WHERE c_acctbal < 5000),
new AS (SELECT c_name AS key, c_acctbal + 1 AS fact, 'fresh' AS status FROM customer WHERE c_acctbal > 1000)
SELECT o.id, o.key, coalesce(n.fact, o.fact) AS fact, o.status, CASE WHEN n.key IS NULL THEN 'unchanged' ELSE 'updated' END AS action FROM old o LEFT JOIN new n USING (key)
UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY n.key), n.key, n.fact, n.status, 'inserted' FROM new n WHERE n.key NOT IN (SELECT key FROM old)
""")
def upsert_preserve(spark, d):
    c = table(spark, d, "customer")
    old = c.where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("key"), F.col("c_acctbal").alias("fact"), F.col("c_mktsegment").alias("status"))
    new = c.where("c_acctbal > 1000").select(F.col("c_name").alias("key"), (F.col("c_acctbal") + 1).alias("fact"), F.lit("fresh").alias("status"))
    return records.upsert(old, new, "key", ["status"]).select("id", "key", "fact", "status", "action")


_BATCH = """
WITH old AS (SELECT c_custkey AS id, c_name AS key, c_acctbal AS fact, c_mktsegment AS status FROM customer WHERE c_acctbal < 5000),
b AS (SELECT 'Customer#' || lpad(CAST(o_custkey AS VARCHAR), 9, '0') AS key, arg_max(o_totalprice, o_orderkey) AS fact, arg_min(o_orderstatus, o_orderkey) AS status, min(o_orderkey) AS came, count(*) AS n FROM orders GROUP BY 1),
t AS (SELECT o.id, o.key, coalesce(b.fact, o.fact) AS fact, o.status, CASE WHEN b.key IS NULL THEN 'unchanged' ELSE 'updated' END AS action, coalesce(n, 0) AS rows_seen FROM old o LEFT JOIN b USING (key)
 UNION ALL SELECT (SELECT max(id) FROM old) + row_number() OVER (ORDER BY came), key, fact, status, 'inserted', n FROM b WHERE key NOT IN (SELECT key FROM old))
"""


def _batch(spark, d):
    """(a table of customers, a batch of orders as rows of theirs: each key comes several times)."""
    old = table(spark, d, "customer").where("c_acctbal < 5000").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("key"), F.col("c_acctbal").alias("fact"), F.col("c_mktsegment").alias("status"))
    key = F.concat(F.lit("Customer#"), F.lpad(F.col("o_custkey").cast("string"), 9, "0"))
    return old, table(spark, d, "orders").select(key.alias("key"), F.col("o_totalprice").alias("fact"), F.col("o_orderstatus").alias("status"), F.col("o_orderkey").alias("ord"))


@query(_BATCH + "SELECT id, key, fact, status, action, rows_seen FROM t")
def upsert_repeated(spark, d):
    """Keys that come several times in a batch: one row each, with the last facts, numbered in the order they came."""
    old, batch = _batch(spark, d)
    return records.upsert(old, batch, "key", ["status"], order="ord").select("id", "key", "fact", "status", "action", "rows_seen")


@query(_BATCH + "SELECT count(*) FILTER (action = 'inserted') AS inserted_count, sum(rows_seen - CASE WHEN action = 'inserted' THEN 1 ELSE 0 END)::BIGINT AS updated_count, 0 AS failed_count FROM t")
def upsert_repeated_counts(spark, d):
    """Each row of a batch counts: the first of a new key as inserted, all others as updated."""
    old, batch = _batch(spark, d)
    return records.upsert_counted(old, batch, "key", ["status"], [], "ord")[2]


@query(_BATCH + "SELECT id, key, fact, status FROM t")
def bucketed_upsert(spark, d):
    """The same through a table in buckets: written, upserted as a second version, read back."""
    old, batch = _batch(spark, d)
    path, shape = shared_folder(spark, "buckets"), "id long, key string, fact double, status string"
    buckets.create_buckets(old, path, "key", buckets=16)
    buckets.upsert_buckets(spark, path, shape, batch, "key", ["status"], [], "ord")
    return buckets.read_buckets(spark, path, shape)


@query("SELECT s_suppkey AS id, CASE WHEN s_suppkey = 3 THEN '感兴趣' ELSE '未查看' END AS status, CASE WHEN s_suppkey = 3 THEN 'call' ELSE '' END AS notes, 'legacy|' || s_suppkey AS deduplication_key, CASE WHEN s_acctbal > 0 THEN s_name ELSE '' END AS locations FROM supplier")
def migrate_and_update(spark, d):
    legacy = table(spark, d, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("title"), F.when(F.col("s_acctbal") > 0, F.col("s_name")).alias("location"))
    return records.set_status(records.migrated(legacy), 3, "感兴趣", "call").select("id", "status", "notes", "deduplication_key", F.array_join("locations", ",").alias("locations"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '[' || '\"' || event_type || '\"' || ']' AS packed, event_type AS unpacked FROM events")
def props_json(spark, d):
    held = records.packed(F.array("event_type"))
    return table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"), held.alias("packed"), records.unpacked(held)[0].alias("unpacked"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def json_repair(spark, d):
    """Every object comes fenced and without its last brace."""
    ready(spark)
    broken = F.concat(F.lit("Answer:\n```json\n"), F.regexp_replace("props", "\\}\\s*$", ""), F.lit("\n```"))
    return table(spark, d, "events").select("event_id", F.from_json(markup.repaired_json(broken), "k long")["k"].alias("k"))


@query("SELECT o_orderkey AS id, CASE o_custkey % 6 WHEN 0 THEN 'bachelor' WHEN 1 THEN 'master' WHEN 2 THEN 'doctorate' WHEN 3 THEN 'associate' WHEN 4 THEN 'high_school' END AS level FROM orders")
def education_levels(spark, d):
    """Levels named in running text of two languages; the lowest one counts, words inside other words do not."""
    forms = ("本科及以上学历，或硕士", "Master's Degree  or PhD required", "Ph.D. or doctoral_degree", "大专学历", "high-school diploma; undergraduate", "mastery of bachelorette parties")
    text = F.get(F.array(*map(F.lit, forms)), (F.col("o_custkey") % 6).cast("int"))
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), education.level_name(education.level_rank(F.concat(F.lit("Asked for: "), text))).alias("level"))


@query("""
SELECT s_suppkey AS id, CASE s_suppkey % 4 WHEN 0 THEN n_name WHEN 1 THEN n_name || ',Elsewhere' WHEN 2 THEN r_name ELSE '' END AS places
FROM supplier JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
""")
def location_names(spark, d):
    """Nations as cities and regions as provinces of the catalogue; names come in other cases, with additions, aliases and separators."""
    ready(spark)
    home = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    cities = home.select(F.col("n_nationkey").cast("int").alias("ord"), F.col("n_name").alias("city"), F.col("r_name").alias("province"), F.array(F.concat(F.lit("old "), "n_name")).alias("aliases"))
    provinces = table(spark, d, "region").select((F.col("r_regionkey") + 100).cast("int").alias("ord"), F.lit(None).cast("string").alias("city"), F.col("r_name").alias("province"), F.array().cast("array<string>").alias("aliases"))
    low, k = F.lower("n_name"), F.col("s_suppkey") % 4
    places = F.when(k == 0, F.array(F.concat(low, F.lit(" City (HQ)")), F.col("r_name"))).when(k == 1, F.array(F.concat(F.lit("OLD "), low, F.lit(" / Elsewhere；"), "n_name"))).when(k == 2, F.array(F.concat(F.lower("r_name"), F.lit(" province")))).otherwise(F.array().cast("array<string>"))
    rows = table(spark, d, "supplier").join(home, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("id"), places.alias("places"))
    return locations.normalize(rows, "id", "places", cities.unionByName(provinces)).select("id", F.array_join("places", ",").alias("places"))


@query("SELECT p_partkey, p_name AS items, concat_ws(',', CASE WHEN p_size > 25 THEN 'target_roles' END, CASE WHEN p_size % 2 = 0 THEN 'skills' END, CASE WHEN p_size % 3 > 0 THEN 'graduation_date' END) AS missing, CASE WHEN p_size > 25 THEN 'Add at least one target role.' ELSE '' END AS asked, NOT (p_size > 25 OR p_size % 2 = 0 OR p_size % 3 > 0) AS complete FROM part")
def profile_fields(spark, d):
    part = table(spark, d, "part").withColumn("items", text.split_items(F.concat("p_name", F.lit(", "), F.upper("p_name"), F.lit("; ;"))))
    none = F.array().cast("array<string>")
    given = part.select("p_partkey", "items", F.when(F.col("p_size") <= 25, F.col("items")).otherwise(none).alias("target_roles"), F.when(F.col("p_size") % 2 == 0, F.array(F.lit("  "))).otherwise(F.col("items")).alias("skills"), F.when(F.col("p_size") % 3 == 0, "June 2026").otherwise("soon").alias("graduation_date"), F.col("items").alias("preferred_locations"))
    asked = F.array_join(F.filter("questions", lambda q: F.contains(q, F.lit("role"))), ",")
    return records.profile_gaps(given).select("p_partkey", F.array_join("items", ",").alias("items"), F.array_join("missing_fields", ",").alias("missing"), asked.alias("asked"), F.col("is_complete").alias("complete"))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_custkey % 5 = 0 THEN 'Told Co' WHEN o_custkey % 5 = 1 THEN 'Labelled ' || o_custkey WHEN o_custkey % 5 = 2 THEN 'Titled ' || o_custkey || ' Ltd' WHEN o_custkey % 5 = 3 THEN 'Source' END AS company_name,
 'j.example' AS source_name, CASE WHEN o_custkey % 2 = 0 THEN 'https://j.example/apply' END AS apply_url, CASE WHEN place = 0 THEN 'first' ELSE 'second' END AS title, CASE WHEN place = 0 THEN 'here' ELSE 'there' END AS places, 'campus' AS recruitment_type
FROM orders CROSS JOIN (SELECT unnest([0, 1]) AS place)
""")
def context_merge(spark, d):
    """Two jobs a page: the company is told by the context, by a label, by the title, by the source, or by none."""
    k, s = F.col("o_custkey"), F.col("o_custkey").cast("string")
    o = table(spark, d, "orders").withColumns({"m": k % 5})
    job = lambda title, place: F.struct(F.lit(title).alias("title"), place.alias("locations"))
    link = lambda kind, url: F.struct(F.lit(url).alias("url"), F.lit("x").alias("text"), F.lit(kind).alias("kind"))
    links = F.when(k % 2 == 0, F.array(link("source", "https://j.example/s"), link("apply", "https://j.example/apply"), link("apply", "https://j.example/2"))).otherwise(F.array(link("source", "https://j.example/s")))
    pages = o.select(
        F.concat(F.lit("https://J.example/"), F.col("o_orderkey").cast("string")).alias("url"), F.lit("").alias("source_name"), F.when(F.col("m") == 3, "Source").alias("source_company_name"), F.lit("x").alias("company_type"), F.lit("there").alias("source_location"), F.lit(True).alias("is_official"),
        F.when(F.col("m") == 2, F.concat(F.lit("Analyst | Titled "), s, F.lit(" Ltd - Jobs"))).otherwise("Analyst").alias("title"), F.when(F.col("m") == 1, F.concat(F.lit("Intro\nEmployer: our client\n Company : Labelled "), s, F.lit(" .\nabout Others"))).otherwise("Nothing told").alias("visible_text"),
        links.alias("important_links"), F.struct(F.when(F.col("m") == 0, "Told Co").otherwise("").alias("company_name"), F.lit("campus").alias("recruitment_type"), F.lit("page").alias("title")).alias("page_context"),
        F.array(job("first", F.array(F.lit("here"))), job("second", F.array().cast("array<string>"))).alias("jobs"),
    )
    m = records.merged_context(pages)
    return m.select(F.regexp_extract("source_url", "([0-9]+)$", 1).cast("long").alias("id"), "company_name", "source_name", "apply_url", "title", F.array_join("locations", ",").alias("places"), "recruitment_type")


@query("SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'O' THEN 'team lead' ELSE 'Degree in law;team lead' END AS facts FROM orders")
def uncovered_facts(spark, d):
    """Facts that the gate covers go."""
    no = F.lit(False)
    facts = eligibility.uncovered_facts(F.array(F.lit("Degree in law"), F.lit("team lead")), {"graduation_known": no, "education_known": F.col("o_orderstatus") == "O", "deadline_known": no, "location_known": no})
    return table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.array_join(facts, ";").alias("facts"))


@query("""SELECT p_partkey, '{"title":"' || p_name || '","description":"' || p_brand || '","requirements":null,"recruitment_type":"campus"}' AS payload FROM part""")
def prompt_payload(spark, d):
    rows = table(spark, d, "part").select("p_partkey", F.col("p_name").alias("title"), F.col("p_brand").alias("description"), F.expr(_NONE).alias("requirements"), F.lit("campus").alias("recruitment_type"), "p_size")
    return rows.select("p_partkey", records.payload("job").alias("payload"))


@query("SELECT o_orderkey AS id, o_orderdate AS first_seen, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey DESC) AS place FROM orders")
def newest_jobs(spark, d):
    """All jobs, newest first, by ranges of their order."""
    rows = table(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("first_seen"), F.expr("-timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01', o_orderdate)").alias("_age"), (-F.col("o_orderkey")).alias("_last"))
    return numbered(rows, "_age", "_last").select("id", "first_seen", F.col("row_no").alias("place"))


@query("SELECT n_name AS company_name, count(s_suppkey) AS job_count FROM supplier JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name")
def company_groups(spark, d):
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    return records.company_order(s.withColumnRenamed("n_name", "company_name"))
