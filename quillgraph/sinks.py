"""Where rows go: JSON lines, text, logs, and an audit trail of intents."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from quillgraph.functions.classify import redact
from quillgraph.plans.graph import FormClass


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: each row as JSON, nulls printed."""
    return df.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("value"))


def list_lines(df: DataFrame, items: str) -> DataFrame:
    """One JSON line for each element of a list column."""
    return df.select(F.explode(items).alias("e")).select(F.to_json("e", {"ignoreNullFields": "false"}).alias("value"))


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Committed whole by the writer, or not at all."""
    json_lines(df).write.mode(mode).text(path)


def write_payload(df: DataFrame, column: str, path: str, mode: str = "errorifexists") -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode(mode).text(path)


def cursor(df: DataFrame) -> Iterator[dict[str, Any]]:
    """Rows one at a time, a partition at once."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator(prefetchPartitions=True))


def log_tap(df: DataFrame, label: str) -> tuple[DataFrame, Observation]:
    """The rows unchanged, and an observation of how many went by."""
    seen = Observation(label)
    return df.observe(seen, F.count(F.lit(1)).alias("rows")), seen


def log_lines(df: DataFrame, label: str) -> DataFrame:
    """`label: row` with secrets blanked."""
    return json_lines(df).select(F.concat(F.lit(f"{label}: "), redact(F.col("value"))).alias("value"))


def saga(df: DataFrame, exchange: str, redo: FormClass, keys: Sequence[str], undo: FormClass | None = None) -> DataFrame:
    """An audit row for each row: what was done, what would undo it, and its key fields."""
    undo = undo or redo.inverse()
    held: list[Column] = [x for k in keys for x in (F.lit(k), F.col(k).cast("string"))]
    return df.select(F.lit(exchange).alias("exchange"), F.lit(redo.value).alias("redo"), F.lit(undo.value if undo else None).cast("string").alias("undo"), F.create_map(*held).alias("keys"))


def append_saga(entries: DataFrame, path: str) -> None:
    json_lines(entries).write.mode("append").text(path)
