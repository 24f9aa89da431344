"""Registered queries and their SQL twins."""

from __future__ import annotations

REGISTRY: dict = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(function):
        REGISTRY[name] = function
        if sql is not None:
            ORACLES[name] = sql
        return function

    return add
