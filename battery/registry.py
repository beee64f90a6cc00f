"""Registered queries and the SQL each must agree with."""

from __future__ import annotations

from collections.abc import Callable

from battery.views import VIEW_SQL

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def with_views(views: str, sql: str) -> str:
    """``sql`` with the named views (and those they use) put in front."""
    wanted = views.split()
    names = [n for n in VIEW_SQL if n in wanted]
    if not names:
        return sql
    heads = ",\n".join(f"{n} AS ({VIEW_SQL[n]})" for n in names)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {heads},\n{body[5:]}"
    return f"WITH {heads}\n{body}"


def query(name: str, sql: str | None = None, views: str = ""):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""
    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = with_views(views, sql)
        return fn

    return register
