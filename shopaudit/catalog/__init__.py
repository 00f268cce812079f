"""Named queries over the driver's tables, each next to an independent SQL statement of what it must return."""
from __future__ import annotations

import functools
from collections.abc import Callable

from ..session import configure
from . import history_queries, page_queries, shop_queries, stream_queries

AREAS = (page_queries, shop_queries, history_queries, stream_queries)


def _configured(query: Callable) -> Callable:
    @functools.wraps(query)
    def run(spark, folder):
        return query(configure(spark), folder)
    return run


def queries() -> dict[str, Callable]:
    return {name: _configured(query) for area in AREAS for name, query in area.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {name: sql for area in AREAS for name, sql in area.ORACLES.items()}
