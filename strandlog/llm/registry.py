"""The queries of this subpackage, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import importlib

from strandlog.llm import pipeline

MODULES = (
    "near_duplicates",
    "secrets",
    "packing",
    "multi_index",
    "language_model",
    "warc",
    "language_id",
    "quality",
    "sharding",
    "decontamination",
)


def _collect(what: str) -> dict:
    found: dict = {}
    for name in MODULES:
        found |= getattr(importlib.import_module(f"strandlog.llm.{name}"), what)
    return found


def queries() -> dict:
    return _collect("QUERY") | {"pipeline": pipeline.run}


def oracle_sql() -> dict[str, str]:
    return _collect("ORACLE") | ({"pipeline": pipeline.ORACLE_SQL} if pipeline.ORACLE_SQL else {})
