"""Named table functions with a trace of their calls."""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def summary(value: object) -> str:
    """What a trace says of a value: the kind, and columns or keys; no job is run for it."""
    if isinstance(value, DataFrame):
        return f"table[{', '.join(value.columns)}]"
    if isinstance(value, dict):
        return f"dict[{', '.join(sorted(map(str, value)))}]"
    return f"list[{len(value)}]" if isinstance(value, list) else type(value).__name__


class Tools:
    """A name belongs to one function; every call leaves an event, a failed one too."""

    def __init__(self, **tools: Callable) -> None:
        self.tools: dict[str, Callable] = {}
        self.calls: list[tuple] = []
        for name, tool in tools.items():
            self.add(name, tool)

    def add(self, name: str, tool: Callable) -> None:
        if name in self.tools:
            raise ValueError(f"a tool of this name is there already: {name}")
        self.tools[name] = tool

    def run(self, name: str, *given, **options):
        if name not in self.tools:
            raise KeyError(f"no tool of this name: {name}")
        began, said, error = time.perf_counter(), "", None
        try:
            out = self.tools[name](*given, **options)
            said = summary(out)
            return out
        except Exception as e:
            error = str(e)
            raise
        finally:
            self.calls.append((len(self.calls), name, "; ".join(map(summary, given)), said, error, int((time.perf_counter() - began) * 1000)))

    def events(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.calls, "ord int, tool string, given string, result string, error string, elapsed_ms int")


def kit(spark: SparkSession, kind: str, sources: list[dict] | None = None, **tools: Callable) -> Tools:
    """Tools for a search that is made up (``mock``), given (``manual``) or the caller's own (``real``)."""
    from ..sources import readers

    search = {"mock": lambda *q: readers.mock_sources(spark, q), "manual": lambda *_: readers.manual_sources(spark, sources or [])}
    if kind not in (*search, "real"):
        raise ValueError(f"unknown kind: {kind}")
    return Tools(**({"web_search": search[kind]} if kind in search else {}), **tools)
