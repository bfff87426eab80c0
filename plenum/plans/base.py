"""The registers that the catalogue's modules fill."""

from __future__ import annotations

from .views import VOTES_SQL

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None, view: bool = True):
    """Register a query; sql goes on from the roll-call view (after a comma if it begins with #), or stands alone."""
    if sql == "":
        raise ValueError(f"{name}: give SQL or leave it out")

    def add(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = f"{VOTES_SQL}{',' if sql.lstrip().startswith('#') else ''} {sql.lstrip().lstrip('#')}" if view else sql
        return f

    return add
