"""Projection, filtering and reshaping, each a function from a DataFrame to a DataFrame."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillgraph.functions import documents


def project(df: DataFrame, document: str, row_path: str, columns: Mapping[str, str | tuple[str, str]], keep: Iterable[str] = ()) -> DataFrame:
    """One row per object at `row_path` of a variant column, with values at dotted paths (text, or with a type given as a pair)."""
    exploded = df.select(*keep, F.explode(documents.rows_at(F.col(document), row_path)).alias("__row")).where(F.schema_of_variant("__row").startswith("OBJECT"))
    picked = {out: (p, "string") if isinstance(p, str) else p for out, p in columns.items()}
    return exploded.select(*keep, *[documents.path_value(F.col("__row"), p, kind).alias(out) for out, (p, kind) in picked.items()])


def select_keys(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    """Exactly these columns; absent ones null."""
    return df.select(*[F.col(k) if k in df.columns else F.lit(None).cast("string").alias(k) for k in keys])


def const_columns(df: DataFrame, fields: Mapping[str, Any]) -> DataFrame:
    """Literal columns, which replace columns of the same name."""
    return df.withColumns({k: F.lit(v) for k, v in fields.items()})


def drop_columns(df: DataFrame, keys: Iterable[str]) -> DataFrame:
    return df.drop(*keys)


def extract(df: DataFrame, raw: Column, fields: Mapping[str, str], literals: Mapping[str, str] | None = None) -> DataFrame:
    """Literals, then text at paths of a variant, onto the row; '' leaves the column as it was (or null). A dotted name builds a struct."""
    new: dict[str, Column] = {k: F.lit(v) for k, v in (literals or {}).items()}
    for out, path in fields.items():
        found = F.nullif(documents.path_text(raw, path), F.lit(""))
        new[out] = F.coalesce(found, F.col(out)) if out in df.columns else F.coalesce(found, new[out]) if out in new else found
    nested: dict[str, dict[str, Column]] = {}
    for out in [k for k in new if "." in k]:
        top, _, rest = out.partition(".")
        nested.setdefault(top, {})[rest] = new.pop(out)
    return df.withColumns(new | {top: F.struct(*[c.alias(n) for n, c in inner.items()]) for top, inner in nested.items()})


def status_branch(status: Column, cases: Mapping[str, Column], raw: Column, default: Column | None = None) -> Column:
    """The case of a status; of others the default, or an error that shows status and body."""
    out = None
    for wanted, value in cases.items():
        out = F.when(status == wanted, value) if out is None else out.when(status == wanted, value)
    last = default if default is not None else F.raise_error(F.concat(F.lit("unexpected status "), F.coalesce(status, F.lit("?")), F.lit(": "), F.coalesce(raw, F.lit(""))))
    return last if out is None else out.otherwise(last)


def require_ok(df: DataFrame, status: str = "status", url: str = "url") -> DataFrame:
    """An error that names the address, for any status that neither starts with 2 nor is empty."""
    s = F.coalesce(F.col(status).cast("string"), F.lit(""))
    checked = F.when(s.startswith("2") | (s == ""), F.col(status)).otherwise(F.raise_error(F.concat(F.lit("status "), s, F.lit(" from "), F.coalesce(F.col(url), F.lit("?")))))
    return df.withColumn(status, checked)


def response_columns(df: DataFrame, body: str = "body") -> DataFrame:
    """status, raw and a tag that marks the raw presentation."""
    return df.withColumnRenamed(body, "raw").withColumn("_tag", F.lit("raw"))


def transform_rows(df: DataFrame, columns: Mapping[str, Column] | None = None, keep: Column | None = None) -> DataFrame:
    """Map by columns, and filter by a predicate that must be true."""
    df = df.withColumns(dict(columns)) if columns else df
    return df.where(keep) if keep is not None else df


def egress(df: DataFrame, steps: Iterable[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    for step in steps:
        df = df.transform(step)
    return df


def echo_inputs(df: DataFrame, params: Mapping[str, str | None]) -> DataFrame:
    """Declared inputs as columns: the value, null if empty; data columns of the same name win. Marked as inputs in the metadata."""
    new = [F.lit(v or None).cast("string").alias(k, metadata={"input": True}) for k, v in params.items() if k not in df.columns]
    return df.select("*", *new)


def add_header(request: Column, name: str, value: Column | str) -> Column:
    """A request struct with one header more (or replaced)."""
    value = F.lit(value) if isinstance(value, str) else value
    kept = F.map_filter(request["headers"], lambda k, _: F.lower(k) != name.lower())
    return request.withField("headers", F.map_concat(kept, F.create_map(F.lit(name), value)))


def substitute(template: str, columns: Iterable[str]) -> Column:
    """`{name}` replaced by the column's text, '' where it is null or no such column exists."""
    import re

    known, parts = set(columns), []
    for at, piece in enumerate(re.split(r"\{([^{}]*)\}", template)):
        parts.append(F.lit(piece) if at % 2 == 0 else F.coalesce(F.col(piece).cast("string"), F.lit("")) if piece in known else F.lit(""))
    return F.concat(*parts)
