"""Registration of queries with the SQL that checks them."""

from __future__ import annotations

from tidewell.sources.adapters import oracle


class Catalogue:
    def __init__(self):
        self.queries: dict = {}
        self.oracles: dict[str, str] = {}

    def query(self, sql: str | None = None, *views: str):
        """Register a query under its function's name."""

        def put(f):
            self.queries[f.__name__] = f
            if sql:
                self.oracles[f.__name__] = oracle(sql, *views)
            return f

        return put
