"""Nulls in any column, empty and very long texts, repeated rows, empty tables, and columns with clashing names, for every operator."""

import pytest
from pyspark.sql import types as T

from quillgraph.llm import common, extraction, language, licenses, mixing, neardup, neighbours, packing, perplexity, quality, repeats

#: Columns that operators use as names of their own.
CLASH = ("mix", "__list", "node", "size", "g", "id", "th", "list", "text_2")
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), *[T.StructField(c, T.StringType()) for c in CLASH]])
LONG = " ".join(f"word{k % 977}" for k in range(60_000))
ROWS = [(1, "a b c d e f", "en", "s"), (1, "a b c d e f", "en", "s"), (2, None, "en", "s"), (3, "", None, None), (None, "null id here", "de", "t"), (None, None, None, None), (4, " \n\t ", "en", "t"), (5, LONG, "en", "s"), (6, LONG, None, None), (7, "é ü 漢字 🎈", "fr", "s"), (8, "1 2 3 - -", "en", "s")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, *CLASH) for r in ROWS], DOCS).repartition(2).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_licenses(docs, none):
    got = licenses.scan(docs)
    assert got.count() == len(ROWS) and licenses.scan(none).count() == 0
    by = {(r["doc_id"], r["n_words"]) for r in got.collect()}
    assert {(1, 6), (2, 0), (3, 0), (None, 3), (None, 0), (4, 0), (5, 60_000), (8, 3), (7, 4)} <= by


def test_mixing(docs, none):
    planned = mixing.plan_mix(docs)
    assert planned.count() == len(ROWS) and planned.columns == [*[c for c in docs.columns if c != "mix"], "mix"]
    assert mixing.mix(none).count() == 0 and mixing.plan_mix(none).count() == 0
    assert all(r["mix"]["copies"] <= 2 and r["mix"]["copies"] >= 0 for r in planned.collect())


def test_quality(docs, none):
    kept = quality.keep_good(docs)
    assert kept.columns == docs.columns and quality.keep_good(none).count() == 0
    assert {r["doc_id"] for r in kept.collect()} <= {5, 6}


def test_perplexity(docs, none):
    model = perplexity.train(docs)
    got = perplexity.score(docs, model)
    assert got.count() == len(ROWS) and perplexity.score(none, model).count() == 0
    assert all(r["n_tokens"] == 1 for r in got.collect() if r["doc_id"] in (2, 3, 4))
    blank = perplexity.score(docs, perplexity.train(none)).collect()
    assert len(blank) == len(ROWS) and all(r["n_known"] == 0 and r["score"] == 0 for r in blank)


def test_packing(docs, none):
    path = packing.default_tokenizer()
    got = packing.pack_documents(docs, path)
    assert packing.pack_documents(none, path).count() == 0
    assert sorted(r["length"] for r in got.collect() if r["doc_id"] in (2, 3, 4)) == [1, 1, 1]


def test_language(docs, none):
    trees = language.train(docs)
    got = language.identify(docs, trees)
    assert got.count() == len(ROWS) and language.identify(none, trees).count() == 0
    assert {r["lang_pred"] for r in got.collect() if r["doc_id"] in (2, 3, 4, 8)} == {"und"}
    assert {r["lang_pred"] for r in language.identify(docs, language.train(none)).collect()} == {"und"}


def test_near_duplicates(docs, none):
    got = rows(neardup.join(docs))
    assert len(got) == len(ROWS) and neardup.join(none).count() == 0
    assert (6, 5, 0, 2) in got and (5, 5, 0, 2) in got and (1, 1, 0, 2) in got and (2, 2, 0, 1) in got
    kept = neardup.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(map(str, [1, 2, 3, None, None, 4, 5, 7, 8]))


def test_repeats(docs, none):
    got = {r["doc_id"]: r for r in repeats.digest(docs).collect()}
    assert got[5]["n_removed"] == got[5]["n_bytes"] == len(LONG) and got[5]["n_spans"] == 1
    assert got[1]["n_removed"] == 0 and repeats.digest(none).count() == 0 and repeats.remove(none).count() == 0
    assert repeats.remove(docs).columns == docs.columns


def test_extraction(spark):
    schema = "page_id long, url string, html string, text string"
    rows_ = [(1, "u", None, "x"), (None, None, "<p>a&amp;b", None), (2, None, "", "x"), (3, "u", "<p>" + "long text " * 200_000, "x"), (4, "u", "<<<>>>&&&&#x;<p", "x"), (5, "u", "no markup", "x")]
    got = {r["page_id"]: r["text"] for r in extraction.extract(spark.createDataFrame(rows_, schema)).collect()}
    assert got[1] == got[2] == "" and got[None] == "a&b" and len(got[3]) == 10 * 200_000 - 1 and got[5] == "no markup"
    assert extraction.extract(spark.createDataFrame([], schema)).count() == 0


def test_neighbours(spark):
    schema = "vec_id long, embedding array<float>, score string"
    vectors = [(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, None), (3, [0.0, 0.0]), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (None, [1.0, 1.0]), (6, [1.0, 0.0]), (6, [1.0, 0.0]), (7, [1.0]), (20, [1.0, 0.0]), (40, [float("inf"), 0.0])]
    df = spark.createDataFrame([(*v, "x") for v in vectors], schema)
    found = neighbours.index(df, 4)
    got = [tuple(r) for r in neighbours.nearest(df.where("vec_id % 20 = 0"), found, 3).orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 6, 1.0), (0, 2, 6, 1.0), (0, 3, 20, 1.0), (20, 1, 0, 1.0), (20, 2, 6, 1.0), (20, 3, 6, 1.0)]
    empty = spark.createDataFrame([], schema)
    assert neighbours.nearest(df, neighbours.index(empty, 4), 3).count() == 0 and neighbours.nearest(empty, found, 3).count() == 0


def test_hot_keys_stay_where_they_are(spark, monkeypatch):
    """The join with its hot keys sent gives the rows of a plain one, and so does a table dealt in parts."""
    monkeypatch.setattr(common, "HOT", 3)
    rows = common.cut(spark.createDataFrame([("a" if k % 2 else f"k{k % 7}", k) for k in range(60)], "key string, n int"))
    table = common.cut(rows.groupBy("key").count())
    plain = sorted(map(tuple, rows.join(table, "key").collect()))
    assert common.rows_of(rows) == 60 and sorted(map(tuple, common.join_weighted(rows, table, ["key"], "count", 60).collect())) == plain
    assert sorted(map(tuple, common.attach(rows, table, "key", 0).collect())) == plain == sorted(map(tuple, common.attach(rows, table, "key", 100).collect()))


def test_workers_keep_no_hashes_between_tasks(spark):
    """Workers are used again by later tasks and stages; what one task remembers must not add to the memory of the next."""

    def work(batches):
        for batch in batches:
            yield {"held": [len(neardup._HASHED)] * batch.num_rows}
            neardup.grams(b"some words of this task alone")

    assert {r["held"] for r in common.map_batches(spark.range(0, 32, 1, 32), work, "held long").collect()} == {0}


def test_the_driver_gives_memory_back(spark, monkeypatch):
    """Writing a table has the driver collect its garbage, at most once in a while."""
    beans = spark.sparkContext._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans
    collected = lambda: sum(b.getCollectionCount() for b in beans() if "Old" in b.getName() or "MarkSweep" in b.getName())
    monkeypatch.setattr(common, "_GIVEN_BACK", [0.0], raising=False)
    before = collected()
    for _ in range(3):
        assert common.rows_of(common.cut(spark.range(5))) == 5
    assert collected() - before == 1
