"""How the plan modules name their queries and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable


class Plans:
    """The queries of one module and, by the same names, their SQL."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable:
        def register(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.sql[name or f.__name__] = sql
            return f

        return register
