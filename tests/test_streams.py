"""Streams against their batch counterparts."""

import pytest
from pyspark.sql import functions as F

from sievewright.operators import admission
from sievewright.streaming import admission as streamed
from sievewright.streaming import backlog

ROWS = [
    [(0, None), (1, "h"), (2, "q"), (3, "a"), (4, "a"), (5, "b"), (6, "both")],
    [(10, "b"), (11, "c"), (12, "a"), (13, "d"), (14, "c"), (15, None), (16, "h")],
    [(20, "d"), (21, "e"), (22, "c"), (23, "e"), (24, "a"), (25, "q")],
]


@pytest.mark.parametrize("limit", [None, 0, 1, 3, 4])
def test_streamed_admission_is_admission_of_the_union(spark, tmp_path, limit):
    keys = lambda *ks: spark.createDataFrame([(k,) for k in ks], "url_key string")
    seen = []

    def turn():
        stream = spark.readStream.schema("ord long, url_key string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        streamed.admit_stream(stream, f"{tmp_path}/out", f"{tmp_path}/ck", limit=limit, queued=keys("q", "both"), handled=keys("h", "both"), then=lambda rows, n: seen.append(n)).awaitTermination(120)

    for n, rows in enumerate(ROWS):
        spark.createDataFrame(rows, "ord long, url_key string").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        if n != 1:  # the second and third part come together, so a batch holds both
            turn()
    every = spark.createDataFrame([r for rows in ROWS for r in rows], "ord long, url_key string")
    want = {r.ord: r.outcome for r in admission.admit(every, keys("q", "both"), keys("h", "both"), limit=limit).collect()}
    assert {r.ord: r.outcome for r in streamed.judged(spark, f"{tmp_path}/out").collect()} == want and seen == [0, 1]


def test_backlog_takes_one_row_of_a_key(spark, tmp_path):
    """Rows of one key differ; the same one is worked on whatever the order they come in, and only once."""
    def turn(out, name, rows):
        spark.createDataFrame(rows, "key long, text string").coalesce(1).write.parquet(f"{tmp_path}/{out}/in/{name}")
        stream = spark.readStream.schema("key long, text string").option("recursiveFileLookup", True).parquet(f"{tmp_path}/{out}/in")
        backlog.work_off(stream, "key", f"{tmp_path}/{out}/out", lambda b: b.withColumn("done", F.lit(True)), f"{tmp_path}/{out}/ck").awaitTermination(60)
        return {(r.key, r.text) for r in spark.read.parquet(f"{tmp_path}/{out}/out/results").collect()}

    one, two = turn("a", "x", [(1, "p"), (1, "q"), (2, "r")]), turn("b", "x", [(2, "r"), (1, "q"), (1, "p")])
    assert one == two and len(one) == 2
    assert turn("a", "y", [(1, "z"), (3, "s")]) == one | {(3, "s")}
