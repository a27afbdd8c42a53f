"""Where a module of queries keeps them and their SQL."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    """``queries`` and ``oracle`` by name, filled by the decorator ``query(sql)``."""

    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracle: dict[str, str] = {}

    def query(self, sql: str | None = None, name: str | None = None) -> Callable[[Callable], Callable]:
        def put(f: Callable) -> Callable:
            self.queries[name or f.__name__] = f
            if sql:
                self.oracle[name or f.__name__] = sql
            return f

        return put
