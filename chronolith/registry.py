"""Where queries and their DuckDB SQL are registered."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function of (spark, sf_dir) under its name; ``sql`` may use the derived views."""

    def add(f: Callable) -> Callable:
        from .plans import views

        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = f"WITH RECURSIVE {views.SQL.strip()}\n{sql.strip()}" if not sql.lstrip().startswith(",") else f"WITH RECURSIVE {views.SQL.strip()}{sql.strip()}"
        return f

    return add
