"""Collects the query modules of the evaluation engine."""

from __future__ import annotations

from . import ORACLES, REGISTRY, dispatch, documents, judgments, runs  # noqa: F401  (registers)


def queries() -> dict:
    return dict(REGISTRY)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
