"""Suffix-array dedup against brute force."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import types as T

from quillgraph.llm import repeats

SCHEMA = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("id", T.StringType())])


def brute(rows, length):
    places = defaultdict(list)
    texts = [(t or "").encode() for _, t in rows]
    for r, t in enumerate(texts):
        for i in range(len(t) - length + 1):
            places[t[i : i + length]].append((r, i))
    gone = [np.zeros(len(t), bool) for t in texts]
    for where in places.values():
        if len(where) > 1:
            for r, i in where:
                gone[r][i : i + length] = True
    out = []
    for (doc, _), t, g in zip(rows, texts, gone, strict=True):
        edges = np.diff(np.concatenate([[0], g.astype(int), [0]]))
        out.append((doc, len(t), int(g.sum()), int((edges == 1).sum()), hashlib.sha256(bytes(b for b, x in zip(t, g, strict=True) if not x)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice("abcdeé") for _ in range(rnd.randint(1, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    passages = [prose(rnd.randint(8, 60)) for _ in range(6)]
    rows = []
    for k in range(n):
        t = prose(rnd.randint(0, 60))
        for _ in range(rnd.randint(0, 3)):
            t += rnd.choice(passages) + prose(rnd.randint(0, 30))
        rows.append((k, t))
    rows += [(900, rows[3][1]), (901, rows[3][1]), (3, rows[3][1]), (902, None), (903, ""), (None, rows[5][1]), (None, "x" * 900), (904, "ab" * 500), (905, passages[0] * 5)]
    near = list(prose(200))
    for k in range(20):
        copy = near.copy()
        copy[rnd.randrange(len(copy))] = "#"
        rows.append((1000 + k, "".join(copy)))
    return rows


@pytest.mark.parametrize(("seed", "length", "group", "block"), [(1, 50, 4000, 1 << 20), (2, 100, 4000, 3000), (3, 60, 3, 2000), (4, 400, 2, 5000)])
def test_matches_brute_force(spark, seed, length, group, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in repeats.digest(df, length, k=16, group=group, block=block).collect()), key=str)
    assert got == brute(rows, length)


def test_empty_and_text_removal(spark):
    assert repeats.digest(spark.createDataFrame([], SCHEMA)).collect() == []
    long = "".join(random.Random(7).choice("abcdefgh ") for _ in range(600))
    df = spark.createDataFrame([(1, "left " + long, "a"), (2, long + " right", "b"), (3, None, "c"), (4, "short", None)], SCHEMA)
    out = {r["doc_id"]: (r["text"], r["id"]) for r in repeats.remove(df).collect()}
    assert out == {1: ("left ", "a"), 2: (" right", "b"), 3: (None, "c"), 4: ("short", None)}


def test_windows_of_pieces():
    rnd = random.Random(5)
    for _ in range(30):
        pieces = [bytes(rnd.choice(b"ab\x00\xff") for _ in range(rnd.randint(0, 80))) for _ in range(5)]
        counts = defaultdict(int)
        for p in pieces:
            for i in range(len(p) - 11):
                counts[p[i : i + 12]] += 1
        got = repeats.repeated_windows(pieces, 12)
        assert [g.tolist() for g in got] == [[counts[p[i : i + 12]] > 1 for i in range(max(0, len(p) - 11))] for p in pieces]


def covered(rows, length):
    """Number of bytes that strings of `length` bytes that start elsewhere too cover, by (id, text)."""
    return sorted(((doc, size, gone) for doc, size, gone, _, _ in brute(rows, length)), key=str)


@pytest.mark.parametrize(("seed", "length", "least", "group", "block"), [(1, 100, 50, 4000, 1 << 20), (2, 120, 70, 4000, 3000), (3, 90, 60, 3, 2000), (4, 400, 250, 2, 5000), (5, 400, 250, 2000, 1 << 20)])
def test_shorter_strings_are_counted_and_left(spark, seed, length, least, group, block):
    rows = corpus(seed)
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], SCHEMA).repartition(3)
    got = [tuple(r) for r in repeats.digest(df, length, k=16, group=group, block=block, least=least).collect()]
    assert sorted((r[:5] for r in got), key=str) == brute(rows, length)
    assert sorted(((r[0], r[1], r[5]) for r in got), key=str) == covered(rows, least)


def test_strings_across_parts_of_long_texts(spark):
    rnd = random.Random(9)
    text = "".join(rnd.choices("abcdefgh ", k=2 * repeats.PART + 100))
    first, second = repeats.PART, 2 * repeats.PART
    rows = [(1, text, "a"), (2, "left" + text[first - 500 : first + 20] + "-" + text[first + 100 : first + 400] + "right", "b"), (3, text[second - 260 : second + 90], "c")]
    got = {r["doc_id"]: (r["n_removed"], r["n_spans"], r["n_repeated"]) for r in repeats.digest(spark.createDataFrame(rows, SCHEMA), least=repeats.PASSAGE).collect()}
    assert got == {1: (520, 1, 1170), 2: (520, 1, 820), 3: (0, 0, 350)}


def test_op10_counts_passages_below_its_length(spark, tmp_path):
    passage, other = ("".join(random.Random(n).choices("abcdefgh ", k=300)) for n in (1, 2))
    rows = [(1, "one " + passage + other[:150], "a"), (2, other[150:] + passage, "b"), (3, other[:60], "c")]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: (r["n_removed"], r["n_repeated"]) for r in repeats.op10_suffix_array_dedup(spark, str(tmp_path)).collect()}
    assert got == {1: (0, 300), 2: (0, 300), 3: (0, 0)}
