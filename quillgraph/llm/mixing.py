"""Mixing sources to target weights: source sizes, capped targets, and a hash-seeded number of copies for each document.

Everything is built from DataFrame functions. Only the aggregate with a row for each source is ordered in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Weights of the sources in code point order, repeating.
WEIGHTS = (5, 2, 1)
#: Words of the mix over words of the input, and the most repetitions of a source.
SHARE, REPEATS = 1.5, 2
#: Up to so many sources, the table of targets (under 100 bytes a row) is sent to all tasks; beyond, it is joined by shuffle.
SENT_SOURCES = 20_000


def size_of(text: Column) -> Column:
    """Number of words `[^\\x20\\x09-\\x0D]+` of a whole text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")).cast("long"), F.lit(0).cast("long"))


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """source, source_size, target for rows (source, size).

    Targets are proportional to the weights, but none is above `repeats` times its source. With the sources in order of
    cap over weight, a source stops at its cap if its share of what the ones before it leave is no less; the others divide the rest.
    """
    by_source = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    cycle = F.element_at(F.array(*map(F.lit, weights)), (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1)
    weighed = by_source.withColumn("weight", cycle).withColumn("cap", repeats * F.col("source_size"))
    everything = Window.partitionBy()
    before = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, -1)
    zero = F.lit(0).cast("long")
    left = weighed.select(
        "*",
        (F.sum("source_size").over(everything) * F.lit(share)).alias("all"),
        F.coalesce(F.sum("cap").over(before), zero).alias("caps_before"),
        (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), zero)).alias("weights_left"),
    )
    capped = left.withColumn("capped", F.col("cap") / F.col("weight") <= (F.col("all") - F.col("caps_before")) / F.col("weights_left"))
    rest = F.col("all") - F.coalesce(F.sum(F.when(F.col("capped"), F.col("cap"))).over(everything), zero)
    open_weight = F.sum(F.when(~F.col("capped"), F.col("weight"))).over(everything)
    return capped.select("source", "source_size", F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(F.col("weight") * (rest / open_weight)).alias("target"))


def draw(key: Column, size: Column, seed: int) -> Column:
    """A number in [0, 1) that depends on the seed, the document's id and its size alone."""
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(key.cast("string"), F.lit("")), F.lit("|"), size.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, seed: int = 0, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """`docs` with a column `mix`: struct<size, source_size, target, copies>.

    copies is the whole part of target over source_size, plus one with a probability equal to the fraction. A null text has
    size 0; a null source is a source of its own, last in order; a source without words takes no copies; repeated rows are drawn
    alike; an empty table gives an empty result. Columns of any name stay as they are (a column `mix` is replaced).
    """
    with_size = docs.withColumn("mix", size_of(F.col(text)))
    own, total, aim = (common.private(docs, c) for c in ("__source", "__source_size", "__target"))
    table = common.cut(targets(docs.select(F.col(source).alias("source"), size_of(F.col(text)).alias("size")), weights, share, repeats)).toDF(own, total, aim)
    small = table.count() <= SENT_SOURCES
    joined = with_size.join(F.broadcast(table) if small else table, F.col(source).eqNullSafe(F.col(own)))
    rate = F.when(F.col(total) > 0, F.col(aim) / F.col(total)).otherwise(0.0)
    copies = F.floor(rate) + F.when(draw(F.col(key), F.col("mix"), seed) < rate - F.floor(rate), 1).otherwise(0)
    columns = [F.col(f"`{c}`") for c in docs.columns if c != "mix"]
    return joined.select(*columns, F.struct(F.col("mix").alias("size"), F.col(total).alias("source_size"), F.col(aim).alias("target"), copies.alias("copies")).alias("mix"))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each row as often as its number of copies."""
    planned = plan_mix(docs, **options).where("mix.copies > 0")
    return planned.withColumn("mix", F.explode(F.sequence(F.lit(1).cast("long"), F.col("mix.copies")))).drop("mix")


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    planned = plan_mix(common.table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return planned.select("doc_id", "mix.size", "mix.source_size", "mix.target", (F.col("mix.size") * F.col("mix.copies")).alias("taken"))


TARGETS_SQL = r"""
sized AS (SELECT *, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size FROM input_docs),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT *, 2 * source_size AS cap,
    [5, 2, 1][((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM by_source),
left_over AS (
  SELECT *, (sum(source_size) OVER ())::DOUBLE * 1.5::DOUBLE AS total,
    coalesce(sum(cap) OVER before, 0)::DOUBLE AS caps_before,
    (sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER before, 0)::DOUBLE AS weights_left
  FROM weighed
  WINDOW before AS (ORDER BY cap::DOUBLE / weight::DOUBLE, source ASC NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap::DOUBLE / weight::DOUBLE <= (total - caps_before) / weights_left AS is_capped FROM left_over),
targets AS (
  SELECT source, source_size,
    CASE WHEN is_capped THEN cap::DOUBLE
      ELSE weight::DOUBLE * ((total - coalesce(sum(CASE WHEN is_capped THEN cap END) OVER (), 0)::DOUBLE)
        / (sum(CASE WHEN NOT is_capped THEN weight END) OVER ())::DOUBLE) END AS target
  FROM capped),
rated AS (
  SELECT s.*, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size::DOUBLE ELSE 0 END AS rate,
    ('0x' || substr(md5('0|' || coalesce(s.doc_id::VARCHAR, '') || '|' || s.size::VARCHAR), 1, 13))::BIGINT::DOUBLE / 4503599627370496::DOUBLE AS draw
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, (floor(rate) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END)::BIGINT AS copies FROM rated)
"""

QUERIES = {"op2_source_mixing": op2_source_mixing}
SQL = {"op2_source_mixing": f"WITH input_docs AS (SELECT * FROM documents), {TARGETS_SQL} SELECT doc_id, size, source_size, target, size * copies AS taken FROM mixed"}
