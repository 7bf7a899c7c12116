"""Filter interaction audit: what each of five filters removes after any others, from the survivors of all their subsets."""

from __future__ import annotations

from itertools import permutations
from math import factorial

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import small, stored

LETTERS = "ABCDE"
#: Bit of each filter in a subset's number, as grouping_id counts them.
BIT = {x: 1 << (len(LETTERS) - 1 - k) for k, x in enumerate(LETTERS)}
ALL = (1 << len(LETTERS)) - 1
#: Tables of up to so many repeated texts (a digest and an id each) are broadcast; larger ones are joined by exchange.
MOST_BROADCAST = 500_000
_COUNTS = ("n", "good", "toxic")


def failures(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``doc_id``, ``part`` and a boolean per filter (A to E, true: the document fails); stored.

    A: under 200 words; B: under half of the words are distinct; C: over 3 % capitals A to Z; D: a character of
    ``#$%&*|``; E: the text of a smaller id. Null text and part count as empty. Equal texts are told by their digest. A
    null id is neither smaller nor larger than others, so its row does not fail E; rows that repeat id and text fail E
    together or not at all.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(part_col), F.lit("")).alias("part"), text.alias("_text"))
    # No white space of these is outside ASCII, and runs of it are cut as one.
    rows = rows.withColumn("_words", F.filter(F.split("_text", "[\\x20\\x09-\\x0D]+"), lambda w: w != ""))
    n, kinds, capitals = F.size("_words"), F.size(F.array_distinct("_words")), F.length(F.regexp_replace("_text", "[^A-Z]+", ""))
    told = stored(
        rows.select("doc_id", "part", (n < 200).alias("A"), (100 * kinds < 50 * n).alias("B"), (100 * capitals > 3 * F.length("_text")).alias("C"), F.col("_text").rlike("[#$%&*|]").alias("D"), F.unhex(F.sha2("_text", 256)).alias("_sha")),
        "filter-flags",
    )
    firsts = stored(told.groupBy("_sha").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first")).where("_n > 1").select("_sha", "_first"), "filter-repeats")
    joined = told.join(small(firsts, MOST_BROADCAST), "_sha", "left")
    return joined.select("doc_id", "part", *LETTERS[:4], F.coalesce(F.col("doc_id") > F.col("_first"), F.lit(False)).alias("E"))


def survivors(flagged: DataFrame) -> DataFrame:
    """Per part and subset of filters (``chosen``, bits as in BIT) the documents that fail none of it: ``n``, ``good``, ``toxic``; zeros too.

    ``flagged``: part, a boolean per filter, good, toxic. Rows are first counted per combination of flags, of which a
    part has 32 at most; CUBE works on these counts. A grouping set is a subset, and of its rows the one whose flags are
    all false counts those that survive it.
    """
    cells = flagged.groupBy("part", *LETTERS).agg(F.count("*").alias("n"), F.count_if("good").alias("good"), F.count_if("toxic").alias("toxic"))
    cube = cells.cube("part", *LETTERS).agg(*(F.sum(c).alias(c) for c in _COUNTS), F.grouping_id().alias("_set"))
    none = F.coalesce(*(F.when(F.col(x), F.lit(False)) for x in LETTERS), F.lit(True))
    clean = cube.where((F.col("_set") <= ALL) & none).select("part", (F.lit(ALL) - F.col("_set")).cast("int").alias("chosen"), *_COUNTS)
    every = cells.select("part").distinct().withColumn("chosen", F.explode(F.sequence(F.lit(0), F.lit(ALL))))
    return every.join(clean, ["part", "chosen"], "left").na.fill(0, list(_COUNTS))


def step_report(held: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step, from :func:`survivors`: survivors of a subset beside those of the subset with one filter more."""
    spark = held.sparkSession
    pairs = [(p, x, p | BIT[x], factorial(p.bit_count()) * factorial(len(LETTERS) - 1 - p.bit_count())) for p in range(ALL + 1) for x in LETTERS if not p & BIT[x]]
    steps = [("".join(o), k + 1, x, sum(BIT[y] for y in o[:k])) for o in permutations(LETTERS) for k, x in enumerate(o)]
    lattice = F.broadcast(spark.createDataFrame(pairs, "chosen int, filter string, _with int, _orders long"))
    after = held.select("part", F.col("chosen").alias("_with"), *(F.col(c).alias(f"_{c}") for c in _COUNTS))
    lost = held.join(lattice, "chosen").join(after, ["part", "_with"]).select("part", "chosen", "filter", "_orders", F.col("_n").alias("kept"), *((F.col(c) - F.col(f"_{c}")).alias(f"{c}_lost") for c in _COUNTS))
    own, lone = Window.partitionBy("part", "filter"), F.lit(ALL) - F.element_at(F.create_map(*(F.lit(v) for x in BIT.items() for v in x)), F.col("filter"))
    told = lost.withColumns({"_fails": F.max(F.when(F.col("chosen") == 0, F.col("n_lost"))).over(own), "unique_fails": F.max(F.when(F.col("chosen") == lone, F.col("n_lost"))).over(own), "shapley": F.sum(F.col("n_lost") * F.col("_orders")).over(own)})
    order = F.broadcast(spark.createDataFrame(steps, "filter_order string, step int, filter string, chosen int"))
    return told.join(order, ["chosen", "filter"]).select("part", "filter_order", "step", "kept", F.col("n_lost").alias("removed"), (F.col("_fails") - F.col("n_lost")).alias("redundant"), "unique_fails", "good_lost", "toxic_lost", "shapley")


def filter_audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """``part``, ``filter_order`` (all orders of the five filters), ``step`` (1 to 5) and counts of documents in the part.

    ``kept`` after the step, ``removed`` by it, ``redundant`` (failing its filter, but removed before), ``unique_fails``
    (failing this filter only), ``good_lost`` and ``toxic_lost`` (removed by it, with a label quality or toxic of 1),
    ``shapley`` (what its filter removes, summed over all orders).

    Every row of ``docs`` is a document, repeats and rows with a null id too; a document has a label if any row of
    ``labels`` with its id says so, and none for a null id. An empty table gives no rows; further columns are not read.
    """
    says = lambda c: F.coalesce(F.bool_or(F.col(c) == 1), F.lit(False))
    told = labels.groupBy(F.col("doc_id").alias("doc_id")).agg(says("quality").alias("good"), says("toxic").alias("toxic"))
    flagged = failures(docs, id_col, text_col, part_col).join(told, "doc_id", "left").na.fill(False, ["good", "toxic"])
    return step_report(stored(survivors(flagged), "filter-survivors"))
