"""Unions and the row budget."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame

from quillgraph.operators.project import egress


def merge(legs: Sequence[DataFrame]) -> DataFrame:
    """Bag union by column name; columns that a leg lacks are null."""
    if not legs:
        raise ValueError("nothing to merge")
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), legs)


def budget(df: DataFrame, limit: int | None) -> DataFrame:
    """At most so many rows of the whole result; below 1 or None: all."""
    return df if limit is None or limit < 1 else df.limit(limit)


def merge_plans(legs: Iterable[tuple[DataFrame, Iterable[Callable[[DataFrame], DataFrame]]]], limit: int | None = None) -> DataFrame:
    """Each leg through its own egress, then one union and one budget."""
    return budget(merge([egress(df, steps) for df, steps in legs]), limit)


def page_size(n: int, most: int = 10_000, usual: int = 1000) -> int:
    return usual if n < 1 else min(n, most)
