"""Approximate nearest neighbours by inner product: a hierarchical navigable small-world graph per shard, kept as flat arrays.

Vectors are dealt to shards of bounded size by their content, so equal vectors meet and are one node with its smallest ids (more than k + 1
of them can never be among k nearest, as ties go to the smaller id). A shard adds one component that makes all norms equal, which turns
the largest inner product into the smallest distance. Its layers are built from exact neighbours within the shard, thinned by the
usual rule: a neighbour is kept if it is nearer to the node than to any neighbour kept before. Queries visit every shard, whose arrays
are memory-mapped, and keep the best of all.
"""

from __future__ import annotations

import math
import os
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Distinct vectors of a shard, neighbours of a node (twice as many in the lowest layer), candidates when building and when searching.
SHARD, NEIGHBOURS, BUILD, SEARCH = 4096, 16, 64, 96
#: Queries searched together.
TOGETHER = 256


def matrix(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Valid vectors of a list column as float64, and their rows. Null, zero, non-finite, incomplete and other-width ones are left out."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(lengths == width)
    if not len(rows) or not width:
        return np.empty((0, width)), rows[:0]
    flat = pc.list_flatten(column.take(pa.array(rows))).cast(pa.float64())
    x = flat.to_numpy(zero_copy_only=False).reshape(-1, width)  # a null component becomes NaN
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return x[good], rows[good]


def pairwise(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances."""
    return np.maximum((a * a).sum(-1)[..., :, None] + (b * b).sum(-1)[..., None, :] - 2 * (a @ np.swapaxes(b, -1, -2)), 0)


def layer(x: np.ndarray, most: int, candidates: int) -> np.ndarray:
    """Neighbour array (-1 fills up) of one layer over the rows of x."""
    n, c = len(x), min(candidates, len(x) - 1)
    if c <= 0:
        return np.full((n, most), -1, np.int32)
    near, far = np.empty((n, c), np.int64), np.empty((n, c))
    kept = np.zeros((n, c), bool)
    for low in range(0, n, 256):
        s = slice(low, min(low + 256, n))
        d = pairwise(x[s], x)
        d[np.arange(len(d)), np.arange(s.start, s.stop)] = np.inf
        part = np.argpartition(d, c - 1, 1)[:, :c] if c < n - 1 else np.argsort(d, 1)[:, :c]
        by = np.argsort(np.take_along_axis(d, part, 1), 1, kind="stable")
        near[s] = np.take_along_axis(part, by, 1)
        far[s] = np.take_along_axis(d, near[s], 1)
        among = pairwise(x[near[s]], x[near[s]])
        chosen = kept[s]
        for r in range(c):
            shadowed = (chosen[:, :r] & (among[:, r, :r] < far[s][:, r : r + 1])).any(1)
            chosen[:, r] = ~shadowed & (chosen[:, :r].sum(1) < most)
    # The nearest that were not kept fill up to half the places; then every edge is also laid in reverse.
    room = most // 2 - kept.sum(1, keepdims=True)
    kept |= ~kept & (np.cumsum(~kept, 1) <= room)
    source, rank = np.nonzero(kept)
    target, d = near[source, rank], far[source, rank]
    a, b, d = np.concatenate([source, target]), np.concatenate([target, source]), np.concatenate([d, d])
    _, once = np.unique(a * n + b, return_index=True)
    a, b, d = a[once], b[once], d[once]
    by = np.lexsort((d, a))
    a, b = a[by], b[by]
    place = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, 2 * most), -1, np.int32)
    fits = place < 2 * most
    out[a[fits], place[fits]] = b[fits]
    return out


def build(x: np.ndarray, neighbours: int = NEIGHBOURS, candidates: int = BUILD) -> dict[str, np.ndarray]:
    """Flat arrays of a graph: lifted vectors, and for each layer its nodes and their neighbours as node numbers."""
    norms = (x * x).sum(1)
    lifted = np.column_stack([x, np.sqrt(np.maximum(norms.max() - norms, 0))])
    draw = np.array([xxhash.xxh3_64_intdigest(v.tobytes()) for v in x], np.uint64) / 2.0**64
    level = np.floor(-np.log(np.maximum(draw, 1e-300)) / math.log(neighbours)).astype(int)
    out, depth = {"lifted": lifted}, 0
    while True:
        nodes = np.flatnonzero(level >= depth)
        if depth and len(nodes) < 2:
            break
        local = layer(lifted[nodes], neighbours, candidates)
        out[f"nodes{depth}"] = nodes.astype(np.int32)
        out[f"edges{depth}"] = np.where(local >= 0, nodes[local], -1).astype(np.int32)
        depth += 1
    return out


def search(graph: dict[str, np.ndarray], queries: np.ndarray, width: int) -> np.ndarray:
    """For each query, up to `width` nodes found in a beam search from the top layer down (-1 fills up)."""
    x, n, m = graph["lifted"], len(graph["lifted"]), len(queries)
    q = np.column_stack([queries, np.zeros(m)])
    away = lambda rows, nodes: ((x[nodes] - q[rows][:, None, :]) ** 2).sum(-1)
    depth = sum(k.startswith("nodes") for k in graph) - 1
    top = graph[f"nodes{depth}"]
    everyone = np.arange(m)
    best = top[pairwise(q, x[top]).argmin(1)]
    for d in range(depth - 1, 0, -1):
        nodes, edges, moving = graph[f"nodes{d}"], graph[f"edges{d}"], everyone
        at = away(everyone, best[:, None])[:, 0]
        while len(moving):
            near = edges[np.searchsorted(nodes, best[moving])]
            dist = np.where(near >= 0, away(moving, near), np.inf)
            k = dist.argmin(1)
            new = dist[np.arange(len(moving)), k]
            gain = new < at[moving]
            moving, k, new, near = moving[gain], k[gain], new[gain], near[gain]
            best[moving], at[moving] = near[np.arange(len(moving)), k], new
    edges = graph["edges0"]
    seen = np.zeros((m, n), bool)
    beam, far, open_ = np.full((m, width), -1), np.full((m, width), np.inf), np.zeros((m, width), bool)
    beam[:, 0], far[:, 0], open_[:, 0] = best, away(everyone, best[:, None])[:, 0], True
    seen[everyone, best] = True
    step, active = 4, everyone
    while len(active):
        rank = np.argsort(~open_[active], 1, kind="stable")[:, :step]  # the nearest not yet expanded come first
        use = np.take_along_axis(open_[active], rank, 1)
        source = np.where(use, np.take_along_axis(beam[active], rank, 1), -1)
        np.put_along_axis(open_[active], rank, False, 1)
        marks = open_[active]
        np.put_along_axis(marks, rank, False, 1)
        open_[active] = marks
        near = np.where(source[:, :, None] >= 0, edges[source], -1).reshape(len(active), -1)
        near = np.sort(near, 1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        fresh = (near >= 0) & ~seen[active[:, None], near]
        rows, cols = np.nonzero(fresh)
        dist = np.full(near.shape, np.inf)
        dist[rows, cols] = ((x[near[rows, cols]] - q[active[rows]]) ** 2).sum(1)
        seen[active[rows], near[rows, cols]] = True
        every = np.concatenate([far[active], dist], 1)
        by = np.argsort(every, 1, kind="stable")[:, :width]
        far[active] = np.take_along_axis(every, by, 1)
        beam[active] = np.take_along_axis(np.concatenate([beam[active], near], 1), by, 1)
        open_[active] = np.take_along_axis(np.concatenate([open_[active], fresh], 1), by, 1)
        active = active[(open_[active] & np.isfinite(far[active])).any(1)]
    return np.where(np.isfinite(far), beam, -1)


class Index:
    """The shards of one folder, opened when first needed and kept mapped by the worker."""

    def __init__(self, path: str, shards: int, width: int):
        self.path, self.shards, self.width, self._open = path, shards, width, {}

    def __getstate__(self):
        return self.__dict__ | {"_open": {}}

    def shard(self, k: int) -> dict[str, np.ndarray] | None:
        if k not in self._open:
            folder = os.path.join(self.path, str(k))
            names = [f[:-4] for f in os.listdir(folder)] if os.path.isdir(folder) else []
            self._open[k] = {f: np.load(os.path.join(folder, f + ".npy"), mmap_mode="r") for f in names}
        return self._open[k] or None


def width_of(rows: DataFrame, vector: str) -> int:
    """The most frequent length of a vector (the larger of two as frequent)."""
    most = rows.where(F.col(vector).isNotNull()).groupBy(F.size(vector).alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    return most["n"] if most else 0


def index(rows: DataFrame, keep: int, shard_size: int = SHARD, neighbours: int = NEIGHBOURS, candidates: int = BUILD, key: str = "vec_id", vector: str = "embedding") -> Index:
    """Build all shards in the shared folder. Every valid row is indexed; of equal vectors, one node with the `keep` smallest ids."""
    width = width_of(rows, vector)
    shards = max(1, math.ceil(rows.count() / shard_size))
    path = common.shared_path(rows.sparkSession, "neighbours")

    def collapse(batches):
        held: dict[bytes, list[int]] = defaultdict(list)
        for batch in batches:
            x, at = matrix(batch.column(1), width)
            ids = batch.column(0).to_pylist()
            for v, row in zip(x, at, strict=True):
                if ids[row] is not None:
                    held[(v + 0.0).tobytes()].append(ids[row])
            if len(held) > 50_000:
                yield from emit(held)
                held.clear()
        yield from emit(held)

    def emit(held):
        if held:
            place = [(xxhash.xxh3_64_intdigest(v) >> 32) * shards >> 32 for v in held]
            yield {"shard": place, "vector": list(held), "ids": [sorted(x)[:keep] for x in held.values()]}

    def assemble(batches):
        nodes: dict[int, dict[bytes, list[int]]] = defaultdict(lambda: defaultdict(list))
        for batch in batches:
            for k, v, ids in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                nodes[k][v] = sorted([*nodes[k][v], *ids])[:keep]
        for k, held in nodes.items():
            order = sorted(held)
            x = np.frombuffer(b"".join(order), np.float64).reshape(-1, width)
            arrays = build(x, neighbours, candidates) | {"vectors": x, "ids": np.array([i for v in order for i in held[v]], np.int64), "bounds": common.slices(np.array([len(held[v]) for v in order]))}
            os.makedirs(os.path.join(path, str(k)), exist_ok=True)
            for name, a in arrays.items():
                sink = pa.BufferOutputStream()
                np.save(sink, a)
                common.write_whole(os.path.join(path, str(k), name + ".npy"), sink.getvalue().to_pybytes())
            yield {"nodes": [len(order)], "ids": [int(arrays["bounds"][-1])]}

    parts = common.map_batches(rows.select(key, vector), collapse, "shard int, vector binary, ids array<long>")
    common.map_batches(parts.repartitionById(shards, F.col("shard")), assemble, "nodes long, ids long").agg(F.sum("nodes")).collect()
    return Index(path, shards, width)


def contenders(graph: dict[str, np.ndarray], hits: np.ndarray, q: np.ndarray, least: np.ndarray, k: int) -> Iterator[tuple[int, list[tuple[int, float]]]]:
    """(query, its nodes and their scores) for each query with any: of the nodes found in a shard (-1 is none) those that score at least
    `least`, and of these the k + 1 best with all that tie with the last."""
    scores = np.where(hits >= 0, (graph["vectors"][hits] * q[:, None, :]).sum(-1), -np.inf)
    if hits.shape[1] > k + 1:
        least = np.maximum(least, -np.partition(-scores, k, 1)[:, k])
    rows, cols = np.nonzero((scores >= least[:, None]) & (hits >= 0))
    nodes, scores, bounds = hits[rows, cols].tolist(), scores[rows, cols].tolist(), common.slices(np.bincount(rows, minlength=len(q)))
    for row in np.flatnonzero(np.diff(bounds)).tolist():
        part = slice(bounds[row], bounds[row + 1])
        yield row, list(zip(nodes[part], scores[part], strict=True))


def nearest(queries: DataFrame, found: Index, k: int, width: int = SEARCH, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows found for each valid query, without the query's own id.

    Scores are inner products of the original vectors in double precision; ties go to the smaller id. Queries that are null, zero,
    not finite or of another width give no rows, nor does a null id; repeated queries are answered each; an empty index gives none.
    """

    def work(batches):
        for batch in batches:
            x, at = matrix(batch.column(1), found.width)
            names = np.array([-1 if i is None else i for i in batch.column(0).to_pylist()], np.int64)[at]
            good = np.array([batch.column(0)[int(r)].is_valid for r in at], bool)
            x, names = x[good], names[good]
            for low in range(0, len(x), TOGETHER):
                q, own = x[low : low + TOGETHER], names[low : low + TOGETHER]
                best: list[list[tuple[float, int]]] = [[] for _ in q]
                least = np.full(len(q), -np.inf)  # scores below can't be among the k best any more
                for s in range(found.shards):
                    graph = found.shard(s)
                    if graph is None:
                        continue
                    hits = search(graph, q, max(width, k + 1))
                    for row, held in contenders(graph, hits, q, least, k):
                        best[row] += [(-score, int(i)) for node, score in held for i in graph["ids"][graph["bounds"][node] : graph["bounds"][node + 1]] if i != own[row]]
                        best[row] = sorted(best[row])[:k]
                        least[row] = -best[row][-1][0] if len(best[row]) == k else -np.inf
                flat = [(own[row], rank, i, -score) for row, hits in enumerate(best) for rank, (score, i) in enumerate(hits, 1)]
                if flat:
                    yield dict(zip(("query_id", "rank", "vec_id", "score"), map(list, zip(*flat, strict=True)), strict=True))

    return common.map_batches(queries.select(key, vector), work, "query_id long, rank int, vec_id long, score double")


def op7_nearest_neighbours(spark: SparkSession, sf_dir: str, k: int = 20) -> DataFrame:
    rows = common.table(spark, sf_dir, "embeddings")
    return nearest(rows.where("vec_id % 20 = 0"), index(rows, k + 1), k)


QUERIES = {"op7_nearest_neighbours": op7_nearest_neighbours}
SQL: dict[str, str] = {}
