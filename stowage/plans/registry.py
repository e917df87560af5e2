"""Queries register themselves with the SQL they must agree with."""

from __future__ import annotations

import re
from collections.abc import Callable

from stowage.plans.fixtures import VIEWS

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a function (spark, sf_dir) -> DataFrame under its name, with its SQL if there is one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = with_views(sql)
        return f

    return add


def with_views(sql: str) -> str:
    """Put the views that a query names, and those that they name, in front of it."""
    used: list[str] = []

    def need(text: str) -> None:
        for name in VIEWS:
            if name not in used and re.search(rf"\b(?:FROM|JOIN|,)\s+{name}\b", text):
                need(VIEWS[name])
                if name not in used:
                    used.append(name)

    need(sql)
    body = sql.strip()
    views = ",\n".join(f"{n} AS ({VIEWS[n]})" for n in used)
    if not used:
        return body
    if body.upper().startswith("WITH RECURSIVE"):
        return f"WITH RECURSIVE {views},\n{body[len('WITH RECURSIVE') :].strip()}"
    if body.upper().startswith("WITH"):
        return f"WITH {views},\n{body[4:].strip()}"
    return f"WITH {views}\n{body}"
