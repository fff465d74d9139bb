"""Bounded semi-naive fixpoint and recursive descent."""

from __future__ import annotations

import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from functools import reduce
from operator import and_

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Progress:
    round: int
    emitted: int


Policy = Callable[[Progress], bool]


def max_iterations(n: int) -> Policy:
    return lambda p: p.round >= n


def max_emitted(n: int) -> Policy:
    """Looked at before each round, so the last round may overshoot."""
    return lambda p: p.emitted >= n


def deadline(seconds: float, clock: Callable[[], float] = time.monotonic) -> Policy:
    end = clock() + seconds
    return lambda p: clock() > end


def any_of(*policies: Policy) -> Policy:
    return lambda p: any(x(p) for x in policies)


def all_of(*policies: Policy) -> Policy:
    """True if all are; of none, never."""
    return lambda p: bool(policies) and all(x(p) for x in policies)


@dataclass
class Fixpoint:
    rows: DataFrame
    iterations: int
    reason: str  # 'fixpoint' or 'terminated'
    counts: list[int] = field(default_factory=list)


class Rounds:
    """Rows of all rounds, each written once below the session's checkpoint folder and read as one table, so that neither the plan nor a
    lost executor's work grows with the rounds, and the planner knows sizes."""

    def __init__(self, seed: DataFrame):
        self.spark, self.schema, self.n = seed.sparkSession, seed.schema, 0
        self.base = shared_path(self.spark, "rounds")

    def add(self, df: DataFrame) -> DataFrame:
        path = f"{self.base}/{self.n}"
        df.write.parquet(path)
        self.n += 1
        return self.spark.read.schema(self.schema).parquet(path)

    def rows(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", "true").parquet(self.base)


#: Rounds of one job where a step is a join with a table.
TOGETHER = 4
ROUND = "__round"


def fixpoint(seed: DataFrame, step: Callable[[DataFrame], DataFrame], key: Sequence[str], policy: Policy | None = None, together: int = 1) -> Fixpoint:
    """All rows that `step` derives from `seed`, one for each key, in the seed's types; null keys are equal to each other.

    Only the newest rows are stepped from, and new keys are found by an anti-join against all seen ones, which sends the seen keys
    to all tasks as long as their files are small, and shuffles beyond that. `together` rounds are one job: their plan steps on from rows that
    may be known already, and a key counts in the first round that reaches it, so the result and the counts are those of single
    rounds. More than one pays for cheap steps over tables; with one, `step` is computed once a round.
    """
    key = list(key)
    seed = seed.withColumns({c: F.col(c).cast("string") for c, kind in seed.dtypes if kind == "void"})
    same = [F.col(f.name).cast(f.dataType).alias(f.name) for f in seed.schema]
    written = Rounds(seed.withColumn(ROUND, F.lit(0)))
    newest = written.add(seed.dropDuplicates(key).withColumn(ROUND, F.lit(0)))
    counts, iterations = [newest.count()], 0

    def result(reason: str) -> Fixpoint:
        return Fixpoint(written.rows().where(F.col(ROUND) <= iterations).drop(ROUND), iterations, reason, counts)

    while counts[-1]:
        rounds, derived = [], newest.where(F.col(ROUND) == iterations).drop(ROUND)
        if policy and policy(Progress(iterations, sum(counts))):
            return result("terminated")
        for ahead in range(1, together + 1):
            derived = step(derived).select(*same).dropDuplicates(key)
            rounds.append(derived.withColumn(ROUND, F.lit(iterations + ahead)))
        found = rounds[0]
        if together > 1:
            every = reduce(DataFrame.unionAll, rounds)
            found = every.groupBy(*[F.col(k).alias(f"__key_{i}") for i, k in enumerate(key)]).agg(F.min_by(F.struct("*"), ROUND).alias("__row")).select("__row.*")
        seen = written.rows().select(*[F.col(k).alias(f"__seen_{i}") for i, k in enumerate(key)])
        known = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__seen_{i}")) for i, k in enumerate(key)])
        newest = written.add(found.join(seen, known, "left_anti"))
        sizes = {r[ROUND]: r["count"] for r in newest.groupBy(ROUND).count().collect()}
        for ahead in range(together):
            if ahead and policy and policy(Progress(iterations, sum(counts))):
                return result("terminated")
            iterations += 1
            counts.append(sizes.get(iterations, 0))
            if not counts[-1]:
                break
    return result("fixpoint")


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below the session's checkpoint folder, which is set where the session has none."""
    import tempfile

    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        shared = spark.conf.get("spark.checkpoint.dir", None)
        if not shared and not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return f"{context._jsc.sc().getCheckpointDir().get()}/{kind}-{uuid.uuid4().hex}"


def descend(roots: DataFrame, children: DataFrame, bind: tuple[str, str], key: str, carry: Sequence[str] = (), policy: Policy | None = None) -> Fixpoint:
    """Rows reachable from `roots`: `bind` is (parent column of `children`, column of a row it equals). `carry` columns go from
    parent to child unless the child has its own."""
    parent, column = bind
    edges = children.select(F.col(parent).alias("__parent"), *[F.col(c).alias(f"__c_{c}") for c in children.columns if c != parent], F.lit(True).alias("__has"))
    own = [c for c in children.columns if c != parent]
    every = list(dict.fromkeys([*roots.columns, *own]))

    def step(frontier: DataFrame) -> DataFrame:
        joined = frontier.join(edges, F.col(column) == F.col("__parent"))
        value = lambda c: F.coalesce(F.col(f"__c_{c}"), F.col(c)) if c in own and c in carry else F.col(f"__c_{c}") if c in own else F.col(c) if c in carry else F.lit(None)
        return joined.select(*[value(c).cast(types[c]).alias(c) for c in every])

    types = dict(children.dtypes) | dict(roots.dtypes)
    start = roots.select(*[(F.col(c) if c in roots.columns else F.lit(None).cast(types[c])).alias(c) for c in every])
    return fixpoint(start, step, [key], policy if policy is not None else max_iterations(64), TOGETHER)
