"""How the parts of the catalogue name their queries."""

from __future__ import annotations


def registry() -> tuple[dict, dict, object]:
    queries, sql = {}, {}

    def query(text: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if text:
                sql[f.__name__] = text
            return f

        return add

    return queries, sql, query
