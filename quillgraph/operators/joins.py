"""Dependent joins: the outer row binds the inner's inputs. Physical strategy is left to the optimiser and adaptive execution."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MARK = "__matched"


def _sides(outer: DataFrame, inner: DataFrame, bindings: Mapping[str, str], how: str) -> tuple[DataFrame, list[str]]:
    """Joined rows with inner columns under private names. `bindings` maps inner input to outer column."""
    renamed = inner.select(*[F.col(f"`{c}`").alias(f"__in_{c}") for c in inner.columns], F.lit(True).alias(MARK))
    on = None
    for target, source in bindings.items():
        equal = F.col(f"`{source}`") == F.col(f"`__in_{target}`")
        on = equal if on is None else on & equal
    if on is None:  # nothing bound: the inner side is the same for all rows (a token, constants)
        return outer.join(renamed, how=how) if how == "inner" else outer.join(renamed, F.lit(True), how), inner.columns
    return outer.join(renamed, on, how), inner.columns


def bind_tuple(outer: DataFrame, inner: DataFrame, bindings: Mapping[str, str]) -> DataFrame:
    """(input, output) of each pair; output is null for an outer row without an inner one."""
    joined, columns = _sides(outer, inner, bindings, "left")
    given = F.struct(*[F.col(f"`{c}`") for c in outer.columns]).alias("input")
    return joined.select(given, F.when(F.col(MARK), F.struct(*[F.col(f"`__in_{c}`").alias(c) for c in columns])).alias("output"))


def bind_flatten(outer: DataFrame, inner: DataFrame, bindings: Mapping[str, str], how: str = "left", keys: bool = True) -> DataFrame:
    """Merged rows. A column on both sides has the inner value where a row matched, null or not, else the outer one.

    `keys=False` leaves out the inner's bound inputs, which equal outer columns.
    """
    joined, columns = _sides(outer, inner, bindings, how)
    columns = [c for c in columns if keys or c not in bindings]
    out: list[Column] = []
    for c in outer.columns:
        both = F.when(F.col(MARK), F.col(f"`__in_{c}`")).otherwise(F.col(f"`{c}`")).alias(c)
        out.append(both if c in columns else F.col(f"`{c}`"))
    return joined.select(*out, *[F.col(f"`__in_{c}`").alias(c) for c in columns if c not in outer.columns])


def inner_flatten(outer: DataFrame, inner: DataFrame, bindings: Mapping[str, str], keys: bool = True) -> DataFrame:
    """As bind_flatten; outer rows without an inner one are dropped."""
    return bind_flatten(outer, inner, bindings, "inner", keys)


def unmatched(outer: DataFrame, inner: DataFrame, bindings: Mapping[str, str]) -> DataFrame:
    """Outer rows without an inner one."""
    joined = inner.select(*[F.col(f"`{t}`").alias(f"__in_{t}") for t in bindings])
    on = None
    for target, source in bindings.items():
        equal = F.col(f"`{source}`") == F.col(f"`__in_{target}`")
        on = equal if on is None else on & equal
    return outer.join(joined, on, "left_anti")


def with_scalar(outer: DataFrame, one_row: DataFrame) -> DataFrame:
    """The columns of a one-row upstream on every row; more than one row is an error, as is none."""
    names = one_row.columns
    held = one_row.limit(2).agg(F.collect_list(F.struct(*names)).alias("rows"))
    checked = held.select(F.when(F.size("rows") == 1, F.col("rows")[0]).otherwise(F.raise_error(F.lit("expected one row"))).alias("one"))
    return outer.crossJoin(F.broadcast(checked)).select(*outer.columns, *[F.col(f"one.{n}") for n in names if n not in outer.columns])
