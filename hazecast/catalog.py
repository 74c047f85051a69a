"""Registry of named queries: a Spark builder plus (optionally) its oracle SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass
class Entry:
    name: str
    build: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    ops: str


REGISTRY: dict[str, Entry] = {}


def register(name: str, sql: str | None = None, ops: str = ""):
    def deco(fn):
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        REGISTRY[name] = Entry(name, fn, sql, ops)
        return fn
    return deco


def load_all() -> dict[str, Entry]:
    from .queries import composite, core, features, model_queries, scoring_queries, tables  # noqa: F401
    from .queries import stream_queries  # noqa: F401  (after the batch keys it reuses)
    return REGISTRY
