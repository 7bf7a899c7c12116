"""Boundaries to models and the network: recorded answers by default, a function per batch where one is given."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.markup import loose_json
from ..session import ready


def recorded(requests: DataFrame, answers: DataFrame, key: str) -> DataFrame:
    """``requests`` with their recorded ``answer``; ``error`` where none was recorded."""
    return requests.join(answers.select(key, "answer"), key, "left").withColumn("error", F.when(F.col("answer").isNull(), "no recorded answer"))


def asked(requests: DataFrame, key: str, make: Callable[[], Callable[[str], str]], attempts: int = 3) -> DataFrame:
    """``key``, ``answer`` (JSON text) and ``error`` per request (``prompt``).

    ``make`` builds the provider once per task. A failed or malformed answer is tried again inside the task; after
    ``attempts`` the row carries its error and the batch goes on. A repeated task asks again, so answers are stored.
    """
    ready(requests.sparkSession)
    kind = requests.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ask = make()
        for batch in batches:
            rows = []
            for k, prompt in zip(batch[key], batch["prompt"], strict=True):
                answer, error = None, None
                for n in range(attempts):
                    try:
                        answer = loose_json(ask(prompt if n == 0 else prompt + "\nReturn valid JSON only."))
                        error = None if answer is not None else "not valid JSON"
                    except Exception as e:
                        error = f"{type(e).__name__}: {e}"
                    if error is None:
                        break
                rows.append((k, answer, error))
            yield pd.DataFrame(rows, columns=[key, "answer", "error"])

    return requests.select(key, "prompt").mapInPandas(run, f"{key} {kind}, answer string, error string")


def parsed(answers: DataFrame, schema: str) -> DataFrame:
    """Answers as structs; one that does not fit its schema becomes an error row."""
    d = answers.withColumn("value", F.from_json("answer", schema, {"mode": "PERMISSIVE"}))
    return d.withColumn("error", F.coalesce("error", F.when(F.col("value").isNull(), "answer does not fit its schema")))
