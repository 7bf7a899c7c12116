"""Place names against a catalogue of cities and provinces."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

CATALOG = "ord int, city string, province string, aliases array<string>"
#: A catalogue of more rows is joined by shuffle.
MOST_BROADCAST = 100_000
# Additions that name no place, and endings of names.
NOISE = "(?i)(?:\\s*[(（\\[]\\s*(?:总部|分部|办事处|办公室|hq|headquarters|office|branch)\\s*[)）\\]]|\\s*[-,:：，]?\\s*(?:总部|分部|办事处|办公室|hq|headquarters|office|branch))\\s*$"
ENDING = "(?i)(?:市|city|省|province)$"


@F.pandas_udf(T.StringType())
def place_key(name: pd.Series) -> pd.Series:
    """Compatibility form, case folded, without spaces and punctuation (no built-in normalises Unicode)."""

    def key(x: str) -> str:
        return "".join(c for c in unicodedata.normalize("NFKC", x).casefold() if not c.isspace() and unicodedata.category(c)[0] != "P")

    return name.map(key, na_action="ignore")


def flattened(nested: DataFrame) -> DataFrame:
    """Catalogue rows of provinces (ord, name, children: name, aliases): their cities, then the provinces themselves."""
    cities = nested.select("ord", F.col("name").alias("province"), F.explode_outer("children").alias("c")).where("c is not null")
    rows = cities.select("ord", F.col("c.name").alias("city"), "province", F.col("c.aliases").alias("aliases"))
    return rows.unionByName(nested.select("ord", F.lit(None).cast("string").alias("city"), F.col("name").alias("province"), F.array().cast("array<string>").alias("aliases")))


# Endings that make a name a city's, a province's, or a region's that stays at the level of provinces.
CITY_ENDING, PROVINCE_ENDING, REGION_ENDING = "(?i)(?:市|city)$", "(?i)(?:省|province)$", "(?:自治区|特别行政区)$"


def parsed_catalog(texts: DataFrame) -> DataFrame:
    """Catalogue rows (see CATALOG) of JSON catalogues (``text``, one each): a list, or an object with the list as ``cities`` or ``data``.

    An entry is a name or an object with ``city`` or ``name``, ``children``, and other names under aliases, alias, pinyin,
    english or en (a text or a list). Provinces with children come before their cities; names keep their order, lose
    their endings and their blanks; regions stay provinces. Entries of any other form are left out. Read as VARIANT, so
    entries may differ in shape.
    """
    got = lambda v, path, kind="string": F.try_variant_get(v, path, kind)
    v = F.try_parse_json("text")
    listed = F.coalesce(got(v, "$", "array<variant>"), got(v, "$.cities", "array<variant>"), got(v, "$.data", "array<variant>"))
    rows = texts.select(F.posexplode(listed).alias("at", "v"))
    kind = F.schema_of_variant("v")

    def names(x: Column) -> Column:
        """Other names of an entry."""
        either = lambda key: F.coalesce(got(x, f"$.{key}", "array<string>"), F.array_compact(F.array(got(x, f"$.{key}"))))
        first = F.when(got(x, "$.aliases", "variant").isNotNull(), either("aliases")).otherwise(either("alias"))
        return F.filter(F.transform(F.concat(first, *(F.array_compact(F.array(got(x, f"$.{k}"))) for k in ("pinyin", "english", "en"))), lambda n: F.trim(n)), lambda n: n != "")

    bare = lambda c, form: F.trim(F.regexp_replace(F.trim(c), form, ""))
    filled = lambda c: F.nullif(c, F.lit(""))
    told = rows.where(kind.startswith("OBJECT") | (kind == "STRING")).select("at", "v", F.trim(F.when(kind == "STRING", got(F.col("v"), "$")).otherwise(F.coalesce(filled(got(F.col("v"), "$.city")), filled(got(F.col("v"), "$.name"))))).alias("name"), F.when(kind.startswith("OBJECT"), got(F.col("v"), "$.children", "array<variant>")).alias("children"), F.when(kind.startswith("OBJECT"), names(F.col("v"))).otherwise(F.array().cast("array<string>")).alias("aliases")).where("name <> ''")
    parent = F.col("children").isNotNull() & ~F.col("name").rlike(REGION_ENDING)
    city = ~parent & F.col("name").rlike(CITY_ENDING)
    own = told.select((F.col("at") * 10_000).alias("ord"), F.when(city, bare(F.col("name"), ENDING)).alias("city"), F.when(~city, bare(F.col("name"), PROVINCE_ENDING)).alias("province"), "aliases")
    child = told.where(parent).select("at", bare(F.col("name"), PROVINCE_ENDING).alias("province"), F.posexplode("children").alias("k", "c")).withColumn("name", filled(got(F.col("c"), "$.name"))).where("name is not null")
    cities = child.select((F.col("at") * 10_000 + F.col("k") + 1).alias("ord"), bare(F.col("name"), ENDING).alias("city"), "province", names(F.col("c")).alias("aliases"))
    return own.unionByName(cities).select(F.col("ord").cast("int").alias("ord"), "city", "province", "aliases")


def catalog_file(spark: SparkSession, path: str) -> DataFrame:
    """The catalogue of a JSON file."""
    return parsed_catalog(spark.read.text(path, wholetext=True).select(F.regexp_replace("value", "^\ufeff", "").alias("text")))


def normalize(rows: DataFrame, key: str, places: str, catalog: DataFrame) -> DataFrame:
    """``rows`` with ``places`` as canonical names in order of first mention.

    A name is a city of the catalogue (its first entry), else a province, else itself; a province whose city is named
    too is left out. Names are split at separators and freed of additions and endings first.
    """
    strip = lambda c: F.trim(F.regexp_replace(F.trim(F.regexp_replace(c, NOISE, "")), ENDING, ""))
    parts = rows.select(key, F.posexplode(F.flatten(F.transform(places, lambda v: F.split(F.trim(F.regexp_replace(v, "(?U)\\s+", " ")), "\\s*[,，;；/\\\\|]\\s*")))).alias("pos", "raw"))
    named = parts.withColumn("name", strip(F.col("raw"))).where("name <> ''").withColumn("_key", place_key(F.regexp_replace("name", ENDING, "")))
    entries = catalog.select("ord", "city", "province", F.explode(F.array_compact(F.concat(F.array(F.coalesce("city", "province")), F.coalesce("aliases", F.array())))).alias("_n"))
    entries = entries.withColumn("_key", place_key(F.regexp_replace("_n", ENDING, "")))
    first = entries.groupBy("_key").agg(F.min_by(F.struct("city", "province"), F.when(F.col("city").isNotNull(), F.col("ord"))).alias("_c"), F.min_by("province", F.when(F.col("city").isNull(), F.col("ord"))).alias("_p"))
    small = catalog.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    told = named.join(F.broadcast(first) if small else first, "_key", "left")
    found = told.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("pos", "name", F.col("_c.city").alias("city"), F.col("_c.province").alias("home"), F.col("_p").alias("province")))).alias("_l"))
    homes = F.array_compact(F.transform("_l", lambda x: F.when(x["city"].isNotNull(), x["home"])))
    names = F.transform("_l", lambda x: F.coalesce(x["city"], F.when(~F.array_contains(homes, F.coalesce(x["province"], F.lit(""))), F.coalesce(x["province"], x["name"]))))
    return rows.drop(places).join(found.select(key, F.array_distinct(F.array_compact(names)).alias(places)), key, "left").withColumn(places, F.coalesce(places, F.array().cast("array<string>")))
