"""Where queries and their SQL are registered."""

from __future__ import annotations

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def with_parts(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)
