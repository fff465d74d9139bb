"""Sources that need no call: literals, lines of files, failing sources."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def literal(spark: SparkSession, rows: Sequence[dict[str, Any]], schema: str | None = None) -> DataFrame:
    """Fixed rows; keys that a row lacks are null."""
    if schema is None:
        names = list(dict.fromkeys(k for r in rows for k in r))
        return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], names)
    from pyspark.sql.types import StructType

    names = StructType.fromDDL(schema).names
    return spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], schema)


def lines(spark: SparkSession, path: str, numbered: bool = False) -> DataFrame:
    """A row for each line; `numbered` adds a number that grows along each file."""
    df = spark.read.text(path).withColumnRenamed("value", "line")
    return df.withColumn("at", F.monotonically_increasing_id()) if numbered else df


def failing(spark: SparkSession, message: str, schema: str = "value string") -> DataFrame:
    """No rows, and an error as soon as it is read."""
    from pyspark.sql.types import StructType

    fields = StructType.fromDDL(schema).fields
    return spark.range(1).select(*[F.raise_error(F.lit(message)).cast(f.dataType).alias(f.name) for f in fields])
