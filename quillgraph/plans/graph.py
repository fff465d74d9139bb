"""The declared graph: named exchanges, value and behaviour edges, plan inputs; validated before anything runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from enum import Enum
from typing import Any

from pyspark.sql import DataFrame, SparkSession


class FormClass(Enum):
    """What a call does to the world."""

    READ = "read"
    CREATE = "create"
    UPDATE = "update"
    DELETE = "delete"

    def inverse(self) -> FormClass | None:
        """What undoes it; nothing undoes a deletion."""
        return {FormClass.READ: FormClass.READ, FormClass.CREATE: FormClass.DELETE, FormClass.UPDATE: FormClass.UPDATE}.get(self)


class PlanError(ValueError):
    """A plan or a method call that cannot be run, found before running."""


@dataclass(frozen=True)
class Beta:
    """Value edge: column `src` of `producer` becomes input `tgt` of `consumer`."""

    producer: str
    consumer: str
    src: str
    tgt: str

    def __str__(self) -> str:
        return f"beta({self.src}→{self.tgt})"


@dataclass(frozen=True)
class Alpha:
    """Behaviour edge: seconds to wait before each call of `consumer` that `producer` leads to."""

    producer: str
    consumer: str
    delay: float


@dataclass(frozen=True)
class Exchange:
    """A node. `source(spark)` is a table whose columns include the inputs; `call` is a request that the row's values fill in.

    how: 'left' keeps rows without an inner one, 'inner' drops them. reshape: applied to the merged rows.
    """

    name: str
    inputs: Sequence[str] = ()
    source: Callable[[SparkSession], DataFrame] | None = None
    call: Any = None
    how: str = "left"
    reshape: Callable[[DataFrame], DataFrame] | None = None
    form: FormClass = FormClass.READ


@dataclass(frozen=True)
class Plan:
    exchanges: Sequence[Exchange]
    betas: Sequence[Beta] = ()
    alphas: Sequence[Alpha] = ()
    inputs: Mapping[str, Mapping[str, Any]] = field(default_factory=dict)  # by exchange
    egress: Sequence[Callable[[DataFrame], DataFrame]] = ()

    def by_name(self) -> dict[str, Exchange]:
        return {e.name: e for e in self.exchanges}

    def bindings(self, name: str) -> dict[str, str]:
        """Inner input to row column, of a node's value edges."""
        return {b.tgt: b.src for b in self.betas if b.consumer == name}

    def delay(self, name: str) -> float:
        return next((a.delay for a in self.alphas if a.consumer == name), 0.0)


def order(plan: Plan) -> list[str]:
    """Names in dependency order; among those that are ready, in order of declaration."""
    names = [e.name for e in plan.exchanges]
    if twice := sorted({n for n in names if names.count(n) > 1}):
        raise PlanError(f"declared twice: {', '.join(twice)}")
    edges = [*plan.betas, *plan.alphas]
    if unknown := sorted({n for e in edges for n in (e.producer, e.consumer) if n not in names}):
        raise PlanError(f"edges name undeclared exchanges: {', '.join(unknown)}")
    if clash := sorted({f"{b.consumer}.{b.tgt}" for b in plan.betas if sum((c.consumer, c.tgt) == (b.consumer, b.tgt) for c in plan.betas) > 1}):
        raise PlanError(f"bound twice: {', '.join(clash)}")
    if clash := sorted({a.consumer for a in plan.alphas if sum(c.consumer == a.consumer for c in plan.alphas) > 1}):
        raise PlanError(f"delayed twice: {', '.join(clash)}")
    waits = {n: {e.producer for e in edges if e.consumer == n} for n in names}
    done: list[str] = []
    while len(done) < len(names):
        ready = next((n for n in names if n not in done and waits[n] <= set(done)), None)
        if ready is None:
            raise PlanError(f"dependency cycle among: {', '.join(n for n in names if n not in done)}")
        done.append(ready)
    return done


def validate(plan: Plan) -> list[str]:
    """The order, if every declared input has a value edge or a non-empty plan input."""
    done = order(plan)
    for e in plan.exchanges:
        bound, given = plan.bindings(e.name), plan.inputs.get(e.name, {})
        for name in e.inputs:
            if name not in bound and given.get(name) in (None, ""):
                raise PlanError(f"input {name!r} of {e.name!r} has neither an edge nor a value")
        if (e.source is None) == (e.call is None):
            raise PlanError(f"{e.name!r} needs a table or a call, and not both")
    return done


def run_dag(jobs: Mapping[str, Callable[[], Any]], after: Mapping[str, Sequence[str]], workers: int = 16) -> dict[str, Any]:
    """Run driver-side jobs, each once all it depends on is done; the first error cancels what has not begun and is raised."""
    from concurrent.futures import FIRST_COMPLETED, ThreadPoolExecutor, wait

    if unknown := sorted({d for ds in after.values() for d in ds if d not in jobs} | {n for n in after if n not in jobs}):
        raise PlanError(f"unknown jobs: {', '.join(unknown)}")
    waits, probe = {n: set(after.get(n, ())) for n in jobs}, set()
    while len(probe) < len(jobs):
        ready = {n for n in jobs if n not in probe and waits[n] <= probe}
        if not ready:
            raise PlanError("dependency cycle")
        probe |= ready
    results: dict[str, Any] = {}
    with ThreadPoolExecutor(max(1, workers)) as pool:
        running: dict[Any, str] = {}
        while len(results) < len(jobs):
            for n in jobs:
                if n not in results and n not in running.values() and waits[n] <= results.keys():
                    running[pool.submit(jobs[n])] = n
            done, _ = wait(running, return_when=FIRST_COMPLETED)
            for f in done:
                name = running.pop(f)
                try:
                    results[name] = f.result()
                except BaseException:
                    for other in running:
                        other.cancel()
                    raise
    return results
