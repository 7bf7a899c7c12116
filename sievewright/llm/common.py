"""Session helpers that the corpus operators share."""

from __future__ import annotations

import ctypes
import os
import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

_PACKAGE_PARENT = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def prepare(spark: SparkSession) -> SparkSession:
    """Let workers import this package; keep their Arrow batches, threads and allocator pools small, as several share an executor."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if _PACKAGE_PARENT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_PACKAGE_PARENT, *paths])
    for name, value in (("OPENBLAS_NUM_THREADS", "1"), ("MALLOC_ARENA_MAX", "2"), ("ARROW_DEFAULT_MEMORY_POOL", "system")):
        env.setdefault(name, value)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    return spark


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder name below ``spark.checkpoint.dir``, which driver and executors share, qualified by Hadoop.

    Where the session has no such setting a local session (tests) gets a temporary folder; a cluster must set one.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        held = sc._jsc.sc().getCheckpointDir()
        if held.isDefined():
            root = held.get()
        elif sc.master.startswith("local"):
            root = "file://" + tempfile.mkdtemp(prefix="sievewright-")
            sc.setCheckpointDir(root)
        else:
            raise ValueError("spark.checkpoint.dir is not set; it must name a folder that driver and executors share")
    path = sc._jvm.org.apache.hadoop.fs.Path(root)
    full = path.getFileSystem(sc._jsc.hadoopConfiguration()).makeQualified(path).toString()
    full = "file://" + full[5:] if full.startswith("file:/") and not full.startswith("file://") else full
    return f"{full.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: lineage ends there. Its rows are counted as they are written."""
    path, seen = shared_dir(df.sparkSession, name), Observation(f"{name}-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at, out._stored_rows = path, int(seen.get.get("n") or 0)
    return out


def discard(*tables: DataFrame) -> None:
    """Remove what :func:`stored` wrote for these tables; nothing may read them afterwards."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        path = sc._jvm.org.apache.hadoop.fs.Path(df._stored_at)
        path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def tidy(run: Callable) -> Callable:
    """``run`` (for mapInArrow), after which a task gives back the memory that its worker holds but no longer uses.

    Workers live on for later stages, and allocators keep freed blocks, so without this each stage adds its own peak.
    """

    def tidied(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
        if trim is not None:
            trim(0)

    return tidied


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def unused(df: DataFrame, *names: str) -> list[str]:
    """``names`` with as many underscores before them as it takes not to be columns of ``df``, whatever their case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        out.append(name)
    return out


def small(df: DataFrame, most: int) -> DataFrame:
    """``df`` marked for broadcast if it has at most ``most`` rows (as counted when it was stored, else now), as it is beyond that."""
    rows = getattr(df, "_stored_rows", None)
    return F.broadcast(df) if (df.limit(most + 1).count() if rows is None else rows) <= most else df
