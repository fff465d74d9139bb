"""Lists to rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def explode_rows(df: DataFrame, items: str, alias: str = "item") -> DataFrame:
    """A row for each element of a list column; empty and null lists give none, null elements are skipped."""
    return df.select(*[c for c in df.columns if c != items], F.explode(items).alias(alias)).where(F.col(alias).isNotNull())


def explode_objects(df: DataFrame, document: str, alias: str = "row") -> DataFrame:
    """A row for each object of a variant that holds a list; other elements, and other documents, are skipped."""
    listed = F.when(F.schema_of_variant(document).startswith("ARRAY"), F.try_variant_get(F.col(document), "$", "array<variant>"))
    return df.select(*[c for c in df.columns if c != document], F.explode(listed).alias(alias)).where(F.schema_of_variant(alias).startswith("OBJECT"))


def member_rows(df: DataFrame, bindings: str = "bindings") -> DataFrame:
    """For a list of <role, members>, a row for each member with its role, kind and name ('kind:name' split at the first colon)."""
    rest = [c for c in df.columns if c != bindings]
    each = df.select(*rest, F.explode(bindings).alias("__b")).select(*rest, F.col("__b.role").alias("role"), F.explode("__b.members").alias("member"))
    colon = F.instr("member", ":")
    return each.withColumns({"kind": F.when(colon > 0, F.expr("substring(member, 1, instr(member, ':') - 1)")).otherwise("unknown"), "name": F.when(colon > 0, F.expr("substring(member, instr(member, ':') + 1)")).otherwise(F.col("member"))})
