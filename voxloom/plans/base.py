"""Registration of queries with their oracles."""

from __future__ import annotations


def registrar() -> tuple[dict, dict, object]:
    """Dictionaries of queries and oracles, and a decorator that fills them."""
    queries: dict = {}
    oracles: dict = {}

    def query(name: str, sql: str | None = None):
        def add(run):
            queries[name] = run
            if sql is not None:
                oracles[name] = sql
            return run

        return add

    return queries, oracles, query
