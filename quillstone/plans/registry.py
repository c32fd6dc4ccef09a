"""All ledger queries with the SQL that each must agree with."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return put


from quillstone.plans import aggregates, documents, extra, joins, rules, scalars, windows  # noqa: E402, F401
