"""A keyed table in buckets of its key: an upsert reads and writes only the buckets that its batch touches.

A folder per write holds the buckets it made (``data/version=N/bucket=B``). The manifest of a version (``manifest/
version=N``) names for every bucket the version that holds it, its rows and its largest id. A version counts once its
manifest is complete, so a write that is lost half way changes nothing, and earlier versions stay readable.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.records import upsert_counted
from ..session import stored

MANIFEST = "bucket int, held_by long, n_rows long, top_id long"


def bucket_of(key: str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def _committed(spark: SparkSession, path: str) -> list[int]:
    """Versions whose manifest is complete."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/manifest")
    fs = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(folder):
        return []
    names = [s.getPath() for s in fs.listStatus(folder)]
    return sorted(int(p.getName().partition("=")[2]) for p in names if fs.exists(spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS")))


def manifest(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """Where each bucket lies in a version (the last one); a row per bucket."""
    told = _committed(spark, path)
    if version is None and not told or version is not None and version not in told:
        raise KeyError(f"no version {'' if version is None else version} below {path}")
    return spark.read.schema(MANIFEST).parquet(f"{path}/manifest/version={told[-1] if version is None else version}")


def _rows(spark: SparkSession, path: str, held: list, schema: str) -> DataFrame:
    folders = [f"{path}/data/version={r['held_by']}/bucket={r['bucket']}" for r in held if r["n_rows"]]
    return spark.read.schema(schema).parquet(*folders) if folders else spark.createDataFrame([], schema)


def read_buckets(spark: SparkSession, path: str, schema: str, version: int | None = None, keys: DataFrame | None = None, key: str | None = None) -> DataFrame:
    """The rows of a version; with ``keys`` only the buckets that could hold these."""
    where = manifest(spark, path, version)
    if keys is not None:
        buckets = where.count()
        where = where.join(keys.select(bucket_of(key, buckets).alias("bucket")).distinct(), "bucket", "left_semi")
    return _rows(spark, path, where.collect(), schema)  # a row per bucket


def _put(rows: DataFrame, path: str, version: int, key: str, buckets: int, id_col: str) -> DataFrame:
    """Write ``rows`` by bucket; what the manifest says of them."""
    rows.withColumn("bucket", bucket_of(key, buckets)).repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/data/version={version}")
    try:
        back = rows.sparkSession.read.parquet(f"{path}/data/version={version}").select(F.col("bucket").cast("int"), F.col(id_col).cast("long").alias("_id"))
    except AnalysisException:  # nothing was written
        return rows.sparkSession.createDataFrame([], MANIFEST)
    return back.groupBy("bucket").agg(F.lit(version).cast("long").alias("held_by"), F.count("*").alias("n_rows"), F.max("_id").alias("top_id"))


def create_buckets(rows: DataFrame, path: str, key: str, buckets: int = 64, id_col: str = "id") -> None:
    """Version 0 of a table."""
    every = rows.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    told = every.join(_put(rows, path, 0, key, buckets, id_col), "bucket", "left").select("bucket", F.coalesce("held_by", F.lit(0)).alias("held_by"), F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("top_id", F.lit(0)).alias("top_id"))
    told.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version=0")


def upsert_buckets(spark: SparkSession, path: str, schema: str, batch: DataFrame, key: str, preserved: list[str], required: list[str], order: str | None = None, id_col: str = "id") -> tuple[dict, DataFrame]:
    """(counts of the batch and of buckets, rows refused) after a batch went in as a new version.

    Only buckets that hold a key of the batch are read and written; the manifest keeps the others where they are. New
    ids go on from the largest one of the whole table, which the manifest tells.
    """
    last = _committed(spark, path)[-1]
    where = manifest(spark, path)
    buckets, top = where.agg(F.count("*"), F.max("top_id")).first()
    held = stored(batch, "bucket-batch")
    touched = stored(where.join(held.where(F.col(key).isNotNull()).select(bucket_of(key, buckets).alias("bucket")).distinct(), "bucket", "left_semi"), "bucket-touched")
    old = _rows(spark, path, touched.collect(), schema)  # a row per bucket
    # A row of its own carries the largest id where the touched buckets do not hold it.
    mark = spark.createDataFrame([(top,)], "_top long").select(*(F.col("_top").alias(f.name) if f.name == id_col else F.lit(None).cast(f.dataType).alias(f.name) for f in old.schema))
    table, refused, _ = upsert_counted(old.unionByName(mark), held, key, preserved, required, order)
    table = stored(table.where(F.col(key).isNotNull()), "bucket-upsert")
    fresh = F.col("action") == "inserted"
    told = table.agg(F.count_if(fresh).alias("inserted_count"), F.coalesce(F.sum(F.col("rows_seen") - fresh.cast("int")), F.lit(0)).alias("updated_count")).first().asDict()
    told |= {"failed_count": refused.count(), "touched_buckets": touched.count(), "buckets": buckets, "version": last + 1}
    names = ("held_by", "n_rows", "top_id")
    made = stored(_put(table.select(*old.columns), path, last + 1, key, buckets, id_col), "bucket-made")
    now = where.join(made.select("bucket", *(F.col(c).alias(f"_{c}") for c in names)), "bucket", "left").select("bucket", *(F.coalesce(f"_{c}", c).alias(c) for c in names))
    now.coalesce(1).write.mode("overwrite").parquet(f"{path}/manifest/version={last + 1}")
    return told, refused
