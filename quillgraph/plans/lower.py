"""A validated plan as one lazy DataFrame: a fold of joins over the order of its exchanges.

The accumulated columns are the row, so a node may bind from any ancestor, and siblings multiply per parent.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.operators.combine import merge_plans
from quillgraph.operators.joins import bind_flatten
from quillgraph.operators.project import egress
from quillgraph.plans.graph import Exchange, Plan, validate


def seed(spark: SparkSession, values: dict) -> DataFrame:
    """One row of plan inputs."""
    return spark.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])


def lower(spark: SparkSession, plan: Plan) -> DataFrame:
    """Rows of the pipeline before egress."""
    nodes, rows = plan.by_name(), None
    for name in validate(plan):
        rows = _stage(spark, plan, nodes[name], rows)
    if rows is None:
        raise ValueError("a plan without exchanges")
    return rows


def _stage(spark: SparkSession, plan: Plan, node: Exchange, rows: DataFrame | None) -> DataFrame:
    given = {k: v for k, v in plan.inputs.get(node.name, {}).items() if v not in (None, "")}
    bound = {t: s for t, s in plan.bindings(node.name).items()}
    if node.call is not None:
        from quillgraph.sources.calls import call_rows

        rows = seed(spark, given) if rows is None else rows.withColumns({k: F.lit(v) for k, v in given.items() if k not in rows.columns})
        out = call_rows(rows, node.call, {**{k: k for k in node.inputs if k not in bound}, **bound}, node.how, plan.delay(node.name))
    else:
        table = node.source(spark)
        fixed = {k: v for k, v in given.items() if k in table.columns and k not in bound}
        for k, v in fixed.items():
            table = table.where(F.col(k) == F.lit(v))
        extra = {k: F.lit(v) for k, v in given.items() if k not in table.columns and (rows is None or k not in rows.columns)}
        if rows is None:
            out = table.withColumns(extra) if extra else table
        else:
            inherited = {k: k for k in node.inputs if k not in bound and k not in given and k in rows.columns and k in table.columns}
            out = bind_flatten(rows, table, {**inherited, **bound}, node.how, keys=False)
            out = out.withColumns(extra) if extra else out
    return out.transform(node.reshape) if node.reshape else out


def compose(spark: SparkSession, plan: Plan) -> DataFrame:
    """Rows of a plan after its egress."""
    return egress(lower(spark, plan), plan.egress)


def compose_all(spark: SparkSession, plans: Iterable[Plan], limit: int | None = None) -> DataFrame:
    """Union of plans, each after its own egress, under one budget."""
    return merge_plans([(lower(spark, p), p.egress) for p in plans], limit)
