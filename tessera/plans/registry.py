"""All queries of the linkage engine with their oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

QUERIES: dict[str, Callable] = {}
ORACLE_SQL: dict[str, str] = {}
FLAGSHIP = "linear_score_full"


def query(sql: str | None):
    """Register a query under its function's name; ``sql`` is its oracle, or None where SQL cannot express it."""

    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def full(f: Callable, linkage: Callable, **more) -> None:
    """Register ``f`` over the runs that ``linkage`` makes, as ``<name>_full`` and without an oracle."""
    QUERIES[f"{f.__name__}_full"] = partial(f, linkage=linkage, **more)


from tessera.plans import queries as _queries  # noqa: E402, F401  (fills the registry)
