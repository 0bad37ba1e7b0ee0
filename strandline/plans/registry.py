"""Collects a module's queries and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from strandline.plans.proxies import with_views


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.sql: dict[str, str] = {}

    def __call__(self, sql: str | None = None) -> Callable:
        """Decorator: registers the function under its name, with the SQL that says the same."""

        def add(f: Callable) -> Callable:
            self.queries[f.__name__] = f
            if sql:
                self.sql[f.__name__] = with_views(sql)
            return f

        return add
