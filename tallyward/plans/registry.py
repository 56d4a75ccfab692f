"""Pairs every query with its SQL while the plan modules declare them."""

from __future__ import annotations


class Registry:
    """Queries and the SQL that states the same result; a query without SQL is checked by tests."""

    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        def register(fn):
            self.queries[name] = fn
            if sql is not None:
                self.oracles[name] = sql
            return fn

        return register
