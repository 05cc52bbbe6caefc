"""Collecting queries and the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable


class Registry:
    def __init__(self) -> None:
        self.queries: dict[str, Callable] = {}
        self.oracles: dict[str, str] = {}

    def __call__(self, name: str, oracle: str | None = None) -> Callable:
        """Decorator: a function of a Catalog becomes a query of (spark, folder)."""

        def add(f: Callable) -> Callable:
            from .plans.catalog import Catalog

            self.queries[name] = lambda spark, d: f(Catalog(spark, d))
            if oracle:
                self.oracles[name] = oracle
            return f

        return add
