"""All registered queries and their SQL checks."""

from __future__ import annotations

import importlib

MODULES = ("reach_queries", "vector_queries", "conversation_queries", "place_queries", "source_queries")


def _modules():
    return [importlib.import_module(f"stopover.plans.{m}") for m in MODULES]


def queries() -> dict:
    return {k: v for m in _modules() for k, v in m.QUERIES.items()}


def oracles() -> dict[str, str]:
    return {k: v for m in _modules() for k, v in m.ORACLES.items()}
