"""The registered queries: one per operator, with the SQL that states the same result."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("quality", "sensitive", "lineage", "fairness", "drift", "catalog", "governance", "streams")


def all_queries() -> dict:
    merged = {}
    for group in _GROUPS:
        merged.update(import_module(f"tallyward.plans.{group}").REGISTRY.queries)
    return merged


def all_oracles() -> dict[str, str]:
    merged = {}
    for group in _GROUPS:
        merged.update(import_module(f"tallyward.plans.{group}").REGISTRY.oracles)
    return merged
