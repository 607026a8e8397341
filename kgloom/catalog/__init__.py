"""The registry of queries and their SQL."""

from __future__ import annotations

import re

from kgloom.catalog import entity_queries, fact_queries, source_queries, triple_queries
from kgloom.catalog.views import VIEWS, duck_view

_ALL = [*triple_queries.QUERIES, *fact_queries.QUERIES, *entity_queries.QUERIES, *source_queries.QUERIES]


def queries() -> dict:
    return {name: run for name, run, _ in _ALL}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL, each with the views that it reads."""
    out = {}
    for name, _, sql in _ALL:
        if sql:
            used = [v for v in VIEWS if re.search(rf"\b{v}\b", sql)]
            head = ",\n".join(f"{v} AS MATERIALIZED ({duck_view(v)})" for v in used)
            recursive = "RECURSIVE " if sql.lstrip().startswith("RECURSIVE") else ""
            sql = sql.lstrip().removeprefix("RECURSIVE").lstrip()
            own = sql.startswith("WITH ")
            out[name] = f"WITH {recursive}{head}{', ' if own and head else ' ' if head else ''}{sql.removeprefix('WITH ')}" if head or own else sql
    return out
