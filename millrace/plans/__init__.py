"""Registered queries: each key has a Spark plan and, where SQL can say it, an oracle."""

from . import (  # noqa: F401
    aggregates,
    filters,
    joins,
    keymodels,
    search,
    sorts,
    statements,
    storage,
    streams,
    text,
    windows,
)
from .registry import ORACLES, QUERIES  # noqa: F401
