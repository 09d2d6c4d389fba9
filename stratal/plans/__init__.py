"""The registered queries, by theme."""

from __future__ import annotations

from importlib import import_module

THEMES = ["ledger_queries", "text_queries", "unit_queries", "publish_queries", "handoff_queries", "context_queries"]


def load() -> None:
    """Imports every theme, which registers its queries."""
    for theme in THEMES:
        import_module(f"stratal.plans.{theme}")
