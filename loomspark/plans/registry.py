"""Collects the queries and oracles of the plan modules."""

from __future__ import annotations

import importlib

MODULES = ("retrieval", "corpus", "evaluation", "construction", "results")


def _all(name: str) -> dict:
    out: dict = {}
    for m in MODULES:
        out |= getattr(importlib.import_module(f"loomspark.plans.{m}"), name)
    return out


def queries() -> dict:
    return _all("QUERIES")


def oracles() -> dict[str, str]:
    return _all("ORACLES")
