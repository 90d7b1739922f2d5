"""End-to-end compositions and the registry of named queries."""

from __future__ import annotations

from importlib import import_module

_CATALOGS = ("panel_queries", "score_queries", "model_queries")


def load_all() -> None:
    """Import every module that registers queries."""
    for name in _CATALOGS:
        import_module(f"{__name__}.{name}")
