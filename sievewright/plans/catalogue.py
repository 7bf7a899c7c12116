"""Queries of the engine's own operators and the SQL that must give the same rows.

The driver's tables hold no postings, so each operator runs over a whole table that is analogous: pages and documents
as pages, orders as jobs or follow-ups, line items as records, events as steps.
"""

from __future__ import annotations

from . import catalogue_pages, catalogue_records, catalogue_runs, catalogue_stages, catalogue_steps, catalogue_views

_PARTS = (catalogue_pages, catalogue_records, catalogue_steps, catalogue_stages, catalogue_runs, catalogue_views)


def queries() -> dict:
    return {k: v for part in _PARTS for k, v in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: v for part in _PARTS for k, v in part.SQL.items()}
