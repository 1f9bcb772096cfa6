"""The training-data queries and the SQL they are held against."""

from __future__ import annotations

import importlib

MODULES = ("exact_dedup", "line_dedup", "mixing", "packing", "media", "html_text", "toxicity", "warc", "jaccard", "suffix_dedup")


def load() -> tuple[dict, dict]:
    queries: dict = {}
    oracle: dict = {}
    for name in MODULES:
        module = importlib.import_module(f"pairloom.llm.{name}")
        queries |= module.QUERIES
        oracle |= module.ORACLE
    return queries, oracle
