"""The queries of this subpackage and their SQL, for the entry module."""

from __future__ import annotations

from importlib import import_module

MODULES = ("quality", "repeats", "leaks", "mixing", "ngram_lm", "urlrules", "toxicity", "language", "merkle", "neardup")


def collect() -> tuple[dict, dict[str, str]]:
    queries: dict = {}
    sql: dict[str, str] = {}
    for name in MODULES:
        module = import_module(f"{__package__}.{name}")
        queries |= module.QUERIES
        sql |= module.SQL
    return queries, sql
