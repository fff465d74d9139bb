"""N-gram Jaccard join against all pairs."""

import random

import numpy as np
import pytest
from pyspark.sql import types as T

from quillgraph.llm import neardup
from quillgraph.llm.components import components

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("node", T.StringType())])


def sets_of(text):
    w = (text or "").lower().split(" ")
    w = [x for x in " ".join(w).split() if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows, t=0.8):
    sets = [sets_of(x) for _, x in rows]
    m = len(rows)
    link = [[bool(a and b) and len(a & b) / len(a | b) >= t - 1e-12 for b in sets] for a in sets]
    root = list(range(m))
    for _ in range(m):
        new = [min([root[i], *(root[j] for j in range(m) if link[i][j])]) for i in range(m)]
        if new == root:
            break
        root = new
    out = []
    for i in range(m):
        ids = [rows[j][0] for j in range(m) if root[j] == root[i] and rows[j][0] is not None]
        copies = sum(sets[j] == sets[i] for j in range(m)) if sets[i] else 1
        out.append((rows[i][0], min(ids, default=None), sum(link[i][j] and sets[i] != sets[j] for j in range(m)), copies))
    return sorted(out, key=str)


def corpus(seed):
    rnd = random.Random(seed)
    vocabulary = ["w%d" % k for k in range(400)]
    rows, k = [], 0
    for _ in range(8):
        base = [rnd.choice(vocabulary) for _ in range(rnd.randint(30, 300))]
        for _ in range(rnd.randint(1, 25)):
            copy = base.copy()
            for _ in range(rnd.choice([0, 0, 1, 2, 3, 8])):
                copy[rnd.randrange(len(copy))] = rnd.choice(vocabulary)
            rows.append((k, rnd.choice([" ", "\n"]).join(copy)))
            k += 1
    return rows + [(None, rows[0][1]), (None, "alone in null"), (5000, None), (5001, ""), (5002, " \t"), (5003, "two words"), (5004, "Two Words"), (3, rows[3][1]), (3, rows[3][1])]


@pytest.mark.parametrize(("seed", "nodes", "grams"), [(1, 1024, 1_000_000), (2, 5, 1_000_000), (3, 1024, 900)])
def test_matches_all_pairs(spark, seed, nodes, grams):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in neardup.join(df, block_nodes=nodes, block_grams=grams).collect()), key=str)
    assert got == brute(rows)


def test_keeps_one_of_each(spark):
    rows = corpus(4)
    df = spark.createDataFrame([(a, b, "x") for a, b in rows], SCHEMA)
    kept = sorted((r["doc_id"] for r in neardup.keep_one(df).collect() if r["doc_id"] is not None))
    classes = {c for _, c, _, _ in brute(rows) if c is not None}
    assert kept == sorted(classes)
    assert neardup.join(df.limit(0)).collect() == []


def test_bands_reach_recall():
    for t in (0.5, 0.8, 0.9):
        bands, rows = neardup.choose_bands(t, 0.9999)
        assert bands * rows <= neardup.HASHES and 1 - (1 - t**rows) ** bands >= 0.9999


def test_components_are_whole_or_an_error(spark):
    path = spark.createDataFrame([(k, k + 1) for k in range(40)], "a long, b long")
    with pytest.raises(RuntimeError, match="after 2 rounds"):
        components(path, rounds=2)
    assert {r["root"] for r in components(path).collect()} == {0}


def test_components(spark):
    rnd = random.Random(2)
    edges = [(k, k + 1) for k in range(40) if k != 20] + [(rnd.randint(100, 160), rnd.randint(100, 160)) for _ in range(40)]
    got = {(r["node"], r["root"]) for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    root = {x: x for e in edges for x in e if e[0] != e[1]}
    for _ in range(200):
        for a, b in edges:
            if a != b:
                root[a] = root[b] = min(root[a], root[b])
    assert got == set(root.items())


def test_shared_counts():
    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 50, rng.integers(1, 40)).astype(np.uint64)) for _ in range(30)]
    got = neardup.shared_counts(sets)
    assert all(got[i, j] == len(np.intersect1d(sets[i], sets[j])) for i in range(30) for j in range(30) if i != j)
