"""A small registry for one topic's queries."""

from __future__ import annotations


class Topic:
    """Queries and, where given, the SQL that must give the same rows."""

    def __init__(self):
        self.queries, self.oracles = {}, {}

    def __call__(self, sql: str | None = None, name: str | None = None):
        def register(fn):
            key = name or fn.__name__
            self.queries[key] = fn
            if sql:
                self.oracles[key] = sql
            return fn
        return register
