"""All queries of this package's own operators and their SQL."""

from __future__ import annotations

from stillpoint.queries import retrieval, selection  # noqa: F401
from stillpoint.queries.base import REGISTRY


def queries() -> dict:
    return {name: fn for name, (fn, _) in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for name, (_, sql) in REGISTRY.items() if sql}
