"""The queries of this subpackage, with the SQL that states the same result where SQL can."""

from __future__ import annotations

from importlib import import_module

MODULES = ("toxicity", "repeats", "mixing", "jaccard", "secrets", "media", "pii", "vectors", "lm_scoring", "packing", "lines", "periodic", "layout")


def modules() -> list:
    return [import_module(f"glosswork.llm.{m}") for m in MODULES]


def queries() -> dict:
    return {m.NAME: m.query for m in modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.ORACLE_SQL for m in modules() if getattr(m, "ORACLE_SQL", None)}
