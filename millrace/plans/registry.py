"""Key → query and key → oracle SQL."""

from __future__ import annotations

from collections.abc import Callable

from .inputs import Inputs, inline

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(key: str, oracle: str | None = None):
    """Register ``fn(inputs)``; derived inputs named in the oracle become CTEs."""

    def wrap(fn):
        QUERIES[key] = lambda spark, sf_dir: fn(Inputs(spark, sf_dir))
        if oracle:
            ORACLES[key] = inline(oracle)
        return fn

    return wrap
