"""Named queries over the driver's tables, each with DuckDB SQL for the same rows."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("reference", "metrics", "governance", "placement", "messaging", "sources", "streams", "platform")


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"strandlog.plans.{name}"), what)
    return found


def all_queries() -> dict:
    return _collect("QUERIES")


def all_oracles() -> dict[str, str]:
    return _collect("ORACLES")
