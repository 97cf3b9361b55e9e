"""Named queries, one or more per row group of the inventory."""

from __future__ import annotations

import importlib

from tidepanel.queries.base import ORACLES, QUERIES, Query

_MODULES = ("expressions", "relational", "analytics", "streams", "styles", "models", "desk", "ingest", "research", "stores")


def queries() -> dict[str, Query]:
    for m in _MODULES:
        importlib.import_module(f"tidepanel.queries.{m}")
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    queries()
    return dict(ORACLES)
