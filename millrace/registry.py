"""Registries: named queries with their SQL, advantage estimators, rewards."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL where one exists."""

    def put(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


class Registry(dict):
    """Named functions; an unknown name says which are known."""

    def __init__(self, kind: str) -> None:
        super().__init__()
        self.kind = kind

    def register(self, name: str):
        def put(f):
            self[name] = f
            return f

        return put

    def __missing__(self, name: str):
        raise NotImplementedError(f"unknown {self.kind} {name!r}; known: {', '.join(sorted(self))}")
