"""Queries of problems 1 and 4 to 10 and their SQL."""

from __future__ import annotations

from orefield.plans.registry import Registry

LLM = Registry()

from orefield.llm import count_queries, text_queries  # noqa: E402, F401  (register their queries)
