"""Set operations: append by name and concatenation of many sources."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame


def append_rows(existing: DataFrame, new: DataFrame) -> DataFrame:
    """Columns matched by name; a column missing on one side becomes null."""
    return existing.unionByName(new, allowMissingColumns=True)


def concat_sources(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
