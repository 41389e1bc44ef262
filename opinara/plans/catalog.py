"""Names queries and keeps their SQL."""

from __future__ import annotations


class Catalog:
    def __init__(self) -> None:
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, name: str, sql: str | None = None):
        """Registers a function of (spark, sf_dir); without SQL it is checked by tests."""

        def add(f):
            if name in self.queries:
                raise ValueError(f"{name} is named twice")
            self.queries[name] = f
            if sql:
                self.oracles[name] = sql
            return f

        return add
