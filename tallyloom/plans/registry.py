"""Registered queries over the driver tables, with the SQL that states the same result."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Register a function (spark, sf_dir) under its name, with its SQL if there is any."""

    def keep(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


from tallyloom.plans import exports, gate, ledger, matching, model, surface, texts, timeline, views  # noqa: E402, F401
