"""The corpus pipeline: quality, exact copies, near copies, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all but the last return the columns
of ``documents``. Null texts count as empty wherever texts are compared and stay null where they are kept; rows with a
null id are kept by the near and repeats stages and packed with a null id; repeated rows are copies of one document for
the exact stage; an empty table goes through all stages as one. Further columns of ``documents`` are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sievewright.llm import catalogue, exact_dedup, mil_quality, near_dedup, packing, suffix_dedup
from sievewright.llm.common import stored, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier of the labelled ones rejects go."""
    return mil_quality.keep_good(docs, mil_quality.train(docs, table(spark, sf_dir, "labels")))


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one with the largest id stays."""
    return exact_dedup.keep_unique(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by five-word shingles (similarity 0.8 or more) the one with the smallest id stays."""
    return near_dedup.keep_first(docs, width=5, percent=80)


def repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that an earlier document holds are cut out; ``n_chars`` follows."""
    return suffix_dedup.trimmed(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of 2048 tokens."""
    return packing.pack_documents(docs, catalogue.tokenizer("word_bpe_49k.json"))


STAGES = [("quality", quality), ("exact", exact), ("near", near), ("repeats", repeats), ("pack", pack)]

#: Training, linking and tokenizing have no form in SQL; tests/llm holds the stages against brute force (quality: against labels).
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
