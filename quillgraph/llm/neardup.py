"""N-gram Jaccard join: documents whose sets of word n-grams reach a similarity, by MinHash banding and full verification.

Equal sets are one node from the start, so copies are never paired. A node's bands are shuffled by their hash, and each bucket ties its
nodes to the smallest one; the components of these ties hold all candidates. A component goes to one task with the full sets of its nodes
if these are few; a larger one is cut by set size (sets that differ by more than the threshold cannot match) and hash into blocks of bounded
size, and pairs of blocks are verified. Verified pairs are counted where they are found and leave a spanning forest, not a row each.
"""

from __future__ import annotations

import math

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.components import components

WORDS, THRESHOLD, RECALL = 5, 0.8, 0.9999
#: Most hash functions, and bounds of a block: nodes, and n-grams in all their sets.
HASHES, BLOCK_NODES, BLOCK_GRAMS = 200, 1024, 1_000_000
#: Up to so many rows, tables about components that are cut into blocks (under 60 bytes a row) are sent to all tasks.
SENT_ROWS = 20_000
#: N-grams hashed at once.
CHUNK = 1 << 15

_HASHED = common.WordHashes()


def choose_bands(threshold: float, recall: float, hashes: int = HASHES) -> tuple[int, int]:
    """Bands and rows: the most rows (fewest chance candidates) for which the bands that reach `recall` at `threshold` need at most `hashes` functions."""
    best = (math.ceil(math.log(1 - recall) / math.log(max(1e-12, 1 - threshold))), 1)
    for rows in range(2, 40):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - threshold**rows))
        if bands * rows <= hashes:
            best = (bands, rows)
    return best


def grams(text: bytes | None, words: int = WORDS) -> np.ndarray:
    """Hashes of the word n-grams of a whole text in order; of all its words if they are fewer than n; none if it has no word."""
    u = _HASHED.of((text or b"").lower().split())
    if not len(u):
        return u
    n = min(words, len(u))
    out = np.zeros(len(u) - n + 1, np.uint64)
    for k in range(n):
        out = out * common.M2 + common.mix(u[k : len(u) - n + 1 + k] + np.uint64(k))
    return common.mix(out + np.uint64(n))


class Signer:
    def __init__(self, bands: int, rows: int):
        rng = np.random.default_rng(20240229)
        self.a = rng.integers(1, 1 << 63, bands * rows, np.uint64) | np.uint64(1)
        self.b = rng.integers(0, 1 << 63, bands * rows, np.uint64)
        self.fold = rng.integers(1, 1 << 63, (bands, rows), np.uint64) | np.uint64(1)
        self.shape = (bands, rows)

    def bands(self, sets: list[np.ndarray]) -> np.ndarray:
        """Band hashes of non-empty sets, one row each."""
        least = np.empty((len(self.a), len(sets)), np.uint64)
        low = 0
        while low < len(sets):
            high, size = low, 0
            while high < len(sets) and (size == 0 or size + len(sets[high]) <= CHUNK):
                size += len(sets[high])
                high += 1
            x = np.concatenate(sets[low:high])
            starts = common.slices(np.array([len(s) for s in sets[low:high]]))[:-1]
            space = np.empty_like(x)
            for j in range(len(self.a)):
                np.multiply(x, self.a[j], out=space)
                space += self.b[j]
                least[j, low:high] = np.minimum.reduceat(space, starts)
            low = high
        mixed = common.mix(least.T.reshape(len(sets), *self.shape)) * self.fold
        return common.mix(mixed.sum(2, dtype=np.uint64) + np.arange(self.shape[0], dtype=np.uint64))


def signatures(keyed: DataFrame, words: int, bands: int, rows: int) -> DataFrame:
    """(id, th, node, grams, bands) for rows (id, th, text); node is null for texts without a word."""

    def work(batches):
        signer = Signer(bands, rows)
        for batch in batches:
            texts = common.as_bytes(batch.column(2))
            for low in range(0, len(texts), 1000):
                sets = [np.unique(grams(t, words)) for t in texts[low : low + 1000]]
                full = [s for s in sets if len(s)]
                signed = iter(signer.bands(full).view(np.int64).tolist() if full else [])
                yield {
                    "id": batch.column(0)[low : low + 1000], "th": batch.column(1)[low : low + 1000],
                    "node": [xxhash.xxh3_128_digest(s.tobytes()) if len(s) else None for s in sets],
                    "grams": [len(s) for s in sets],
                    "bands": [next(signed) if len(s) else None for s in sets],
                }

    return common.map_batches(keyed, work, "id long, th long, node binary, grams int, bands array<long>")


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of the sets, exactly.

    N-grams held by the same sets are one column with a weight, so a group of near copies has few columns.
    """
    m = len(sets)
    lengths = np.array([len(s) for s in sets])
    gram, owner = np.concatenate(sets), np.repeat(np.arange(m), lengths)
    order = np.argsort(gram, kind="stable")
    gram, owner = gram[order], owner[order]
    starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
    sizes = np.diff(np.append(starts, len(gram)))
    starts, sizes = starts[sizes > 1], sizes[sizes > 1]
    out = np.zeros((m, m), np.float32)
    if not len(starts):
        return out
    owner = owner[common.ranges(starts, sizes)]
    at = common.slices(sizes)[:-1]
    marks = common.mix(np.arange(m, dtype=np.uint64) + np.uint64(1)), common.mix(np.arange(m, dtype=np.uint64) + np.uint64(1 << 40))
    tags = np.stack([np.add.reduceat(x[owner], at) for x in marks], 1)
    _, first, weight = np.unique(tags, axis=0, return_index=True, return_counts=True)
    for low in range(0, len(first), 2048):
        part = first[low : low + 2048]
        x = np.zeros((m, len(part)), np.float32)
        x[owner[common.ranges(at[part], sizes[part])], np.repeat(np.arange(len(part)), sizes[part])] = 1
        out += (x * weight[low : low + 2048].astype(np.float32)) @ x.T
    return out


def verify(sets: list[np.ndarray], sides: np.ndarray, threshold: float) -> np.ndarray:
    """Which pairs reach the threshold; sides 1 and 2 are two blocks of which only pairs across count, side 0 is one block."""
    n = np.array([len(s) for s in sets], np.float64)
    both = shared_counts(sets).astype(np.float64)
    linked = both + 1e-9 >= threshold * (n[:, None] + n[None, :] - both)
    np.fill_diagonal(linked, False)
    if sides.any():
        linked &= sides[:, None] != sides[None, :]
    return linked


def roots(linked: np.ndarray) -> np.ndarray:
    """Smallest index of each component of a boolean matrix."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(linked)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


def sent(table: DataFrame) -> DataFrame:
    """A written table, marked for sending to all tasks if it is small; beyond, the join shuffles, and splits hot keys."""
    return F.broadcast(table) if table.count() <= SENT_ROWS else table


def assign(nodes: DataFrame, ties: DataFrame, threshold: float, block_nodes: int, block_grams: int) -> DataFrame:
    """(node, task, side, whole): in which tasks a candidate node is verified. `whole` tasks hold a whole component."""
    placed = common.cut(components(ties).join(nodes.select("node", "grams"), "node"))
    placed = placed.withColumn("size", F.floor(F.log(F.col("grams").cast("double")) / math.log(1 / threshold)))
    sizes = placed.groupBy("root").agg(F.count("*").alias("nodes"), F.sum("grams").alias("total"))
    cut_roots = common.cut(sizes.where((F.col("nodes") > block_nodes) | (F.col("total") > block_grams)).select("root", F.lit(True).alias("cut")))
    flagged = placed.join(sent(cut_roots), "root", "left")
    single = flagged.where("cut is null").select("node", F.xxhash64("root").alias("task"), F.lit(0).alias("side"), F.lit(True).alias("whole"))
    if cut_roots.isEmpty():
        return single
    cut_up = flagged.where("cut").drop("cut")
    counts = cut_up.groupBy("root", "size").agg(F.count("*").alias("nodes"), F.sum("grams").alias("total"))
    parts = common.cut(counts.select("root", "size", F.greatest(F.ceil(F.col("nodes") / block_nodes), F.ceil(F.col("total") / block_grams)).cast("int").alias("parts")))
    blocks = parts.select("root", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"))
    other = blocks.select("root", F.col("size").alias("size2"), F.col("part").alias("part2"))
    pairs = blocks.join(other, "root").where("(size = size2 and part <= part2) or size + 1 = size2")
    ends = pairs.select("root", "size", "part", F.xxhash64("root", "size", "part", "size2", "part2").alias("task"), F.when(F.expr("size = size2 and part = part2"), 0).otherwise(1).alias("side")).union(
        pairs.where("not (size = size2 and part = part2)").select("root", F.col("size2").alias("size"), F.col("part2").alias("part"), F.xxhash64("root", "size", "part", "size2", "part2").alias("task"), F.lit(2).alias("side"))
    )
    dealt = cut_up.join(sent(parts), ["root", "size"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    ends = common.cut(ends)
    return single.union(dealt.join(sent(ends), ["root", "size", "part"]).select("node", "task", "side", F.lit(False).alias("whole")))


def links(keyed: DataFrame, nodes: DataFrame, tasks: DataFrame, words: int, threshold: float) -> DataFrame:
    """(node, linked, docs, parent, whole) per task: verified links of a node, the documents behind them, and an edge of the spanning forest."""
    wanted = tasks.join(nodes.select("node", "copies", "rep"), "node").select("rep.*", F.struct("node", "task", "side", "whole", "copies").alias("t"))
    wanted = wanted.groupBy("id", "th").agg(F.collect_list("t").alias("list"))  # a text's tasks: one, or one for each block its own meets
    texts = keyed.join(wanted.hint("shuffle_hash"), ["id", "th"]).select("text", "list")

    def spread_sets(batches):
        for batch in batches:
            for text, todo in zip(common.as_bytes(batch.column(0)), batch.column(1).to_pylist(), strict=True):
                data = np.unique(grams(text, words)).tobytes()
                for low in range(0, len(todo), 64):
                    part = todo[low : low + 64]
                    yield {name: [t[name] for t in part] for name in ("task", "side", "node", "copies", "whole")} | {"set": [data] * len(part)}

    def solve(held: dict):
        names = sorted(held)
        sets = [np.frombuffer(held[k][0], np.uint64) for k in names]
        side, copies = np.array([held[k][1] for k in names]), np.array([held[k][2] for k in names], np.int64)
        linked = verify(sets, side, threshold)
        found = linked.any(1)
        if found.any():
            root, at = roots(linked), np.flatnonzero(found)
            yield {"node": [names[k] for k in at], "linked": linked.sum(1)[at], "docs": (linked * copies[None, :]).sum(1)[at], "parent": [names[k] for k in root[at]], "whole": [held[names[k]][3] for k in at]}

    def by_task(batches):
        held, last = {}, None
        for batch in batches:
            for task, side, node, copies, whole, data in zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True):
                if task != last:
                    if held:
                        yield from solve(held)
                    held, last = {}, task
                held.setdefault(node, (data, side, copies, whole))
        if held:
            yield from solve(held)

    sets = common.map_batches(texts, spread_sets, "task long, side int, node binary, copies long, whole boolean, set binary")
    return common.map_batches(sets.repartition("task").sortWithinPartitions("task"), by_task, "node binary, linked long, docs long, parent binary, whole boolean")


def grouped(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, recall: float = RECALL, block_nodes: int = BLOCK_NODES, block_grams: int = BLOCK_GRAMS, text: str = "text", key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """Members (id, th, node, times) and nodes (node, copies, linked, docs, rep, root, root_rep, root_id).

    rep is the smallest (id, th) of a node, root_rep that of its group of directly or indirectly linked nodes, root_id the group's
    smallest id. Words are lower-cased (A-Z) and split at white space.
    """
    keyed = docs.select(F.col(key).cast("long").alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))
    keyed = keyed.withColumn("id", F.coalesce("id", F.lit(1 << 62)))  # null ids come last
    signed = signatures(keyed, words, *choose_bands(threshold, recall))
    members = common.cut(signed.where("node is not null").groupBy("node", "id", "th").agg(F.count("*").alias("times"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))
    nodes = common.cut(members.groupBy("node").agg(F.sum("times").alias("copies"), F.min(F.struct("id", "th")).alias("rep"), F.first("grams").alias("grams"), F.first("bands").alias("bands")))
    buckets = nodes.select("node", F.explode("bands").alias("band"))
    hubs = buckets.groupBy("band").agg(F.count("*").alias("n"), F.min("node").alias("hub")).where("n > 1")
    ties = buckets.join(hubs, "band").where("node <> hub").select(F.col("node").alias("a"), F.col("hub").alias("b")).distinct()
    tasks = assign(nodes, ties, threshold, block_nodes, block_grams)
    found = common.cut(links(keyed, nodes, tasks, words, threshold))
    totals = found.groupBy("node").agg(F.sum("linked").alias("linked"), F.sum("docs").alias("docs"))
    forest = found.where("whole").select("node", F.col("parent").alias("root"))
    several = found.where("not whole").select(F.col("node").alias("a"), F.col("parent").alias("b"))
    if not several.isEmpty():
        forest = forest.union(components(several))
    joined = nodes.drop("bands").join(totals, "node", "left").join(forest, "node", "left").withColumn("root", F.coalesce("root", "node"))
    leaders = joined.groupBy("root").agg(F.min("rep").alias("root_rep"), F.count("*").alias("sets"))
    lead = common.cut(joined.join(leaders, "root").na.fill(0, ["linked", "docs"]))
    return members.drop("bands", "grams"), lead


def join(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, class_id, n_links, n_copies.

    class_id is the smallest doc_id that is linked, directly or not; n_links counts the documents with a different set of n-grams that reach
    the similarity, n_copies the documents with the same set, itself included. A text without a word (null, empty) has no n-gram:
    it links to nothing and is its own class. Null ids take part and come last in the order; a class of only such has a null
    id. Repeated rows are copies. An empty table gives an empty result; no other column is read.
    """
    text, key = options.get("text", "text"), options.get("key", "doc_id")
    members, nodes = grouped(docs, **options)
    last = F.lit(1 << 62)
    rows = members.join(nodes, "node").select("id", "th", "times", F.col("root_rep.id").alias("class_id"), F.col("docs").alias("n_links"), F.col("copies").alias("n_copies"))
    some = rows.withColumn("again", F.explode(F.sequence(F.lit(1).cast("long"), F.col("times")))).select("id", "class_id", "n_links", "n_copies")
    wordless = docs.where(~F.coalesce(F.col(text), F.lit("")).rlike(r"[^\x20\x09-\x0D]")).select(F.coalesce(F.col(key).cast("long"), last).alias("id")).select("id", F.col("id").alias("class_id"), F.lit(0).cast("long").alias("n_links"), F.lit(1).cast("long").alias("n_copies"))
    out = some.union(wordless)
    return out.select(*[F.when(F.col(c) != last, F.col(c)).alias(n) for c, n in (("id", "doc_id"), ("class_id", "class_id"))], "n_links", "n_copies")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """`docs` without all but one document of each class (the one with the smallest id, then text hash); columns stay as they are."""
    text, key = options.get("text", "text"), options.get("key", "doc_id")
    members, nodes = grouped(docs, **options)
    i, h = common.private(docs, "__id"), common.private(docs, "__th")
    lost = members.join(nodes.select("node", "root_rep"), "node").where("struct(id, th) <> root_rep").select("id", "th").toDF(i, h)
    ident, hashed = F.coalesce(F.col(key).cast("long"), F.lit(1 << 62)), F.xxhash64(F.coalesce(F.col(text), F.lit("")))
    kept = docs.join(lost.hint("shuffle_hash"), (ident == F.col(i)) & (hashed == F.col(h)), "left_anti")
    repeated = members.where("times > 1").select("id", "th").toDF(i, h)
    if repeated.isEmpty():
        return kept
    matches = (ident == F.col(i)) & (hashed == F.col(h))
    once = kept.join(repeated, matches, "left_anti")
    again = kept.join(repeated, matches, "left_semi").withColumn(i, ident).withColumn(h, hashed).dropDuplicates([i, h]).drop(i, h)
    return once.union(again)


def op9_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return join(common.table(spark, sf_dir, "documents"))


QUERIES = {"op9_ngram_jaccard": op9_ngram_jaccard}
SQL: dict[str, str] = {}
