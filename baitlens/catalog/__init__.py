"""Named queries over the driver's tables."""

from __future__ import annotations

from importlib import import_module

from .base import ORACLES, QUERIES, Query

MODULES = ["urls", "texts", "splits", "quality", "numeric", "vectors", "files", "streams"]


def _load() -> None:
    for name in MODULES:
        import_module(f"{__name__}.{name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(ORACLES)
