"""Each stage's decisions, and the whole pipeline, on rows with known cases."""

import random
from collections import Counter

import corpus_pipeline
from tests.llm.test_scoring import prose


def test_stages(spark, tmp_path):
    rnd = random.Random(1)
    letters = "abcdefghijklmnopqrstuvwxyz"
    clean = [prose(rnd, rnd.randint(80, 200), letters) for _ in range(120)]
    passage = prose(rnd, 150, letters)
    rows = [(k, t, "en", f"s{k % 3}") for k, t in enumerate(clean)]
    rows += [(200, clean[0], "en", "s0"), (201, clean[1] + " tail", "en", "s1"), (202, "too short", "en", "s0"), (203, None, None, None)]
    rows += [(300, passage + " " + clean[50][:200], "en", "s0"), (301, prose(rnd, 90, letters) + " " + passage, "en", "s1")]
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    df.repartition(2).write.parquet(str(tmp_path / "documents.parquet"))
    docs, seen = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        seen[name] = docs.collect()
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == df.columns and docs.dtypes == df.dtypes
    ids = lambda name: {r["doc_id"] for r in seen[name]}
    assert ids("quality_rules") == {r[0] for r in rows} - {202, 203}
    assert ids("near_duplicates") == ids("quality_rules") - {200, 201}
    kept = {r["doc_id"]: r for r in seen["suffix_array_dedup"]}
    assert kept.keys() == ids("near_duplicates")
    assert all(kept[k]["text"] == clean[k] for k in range(120)) and passage[:400] not in kept[300]["text"] + kept[301]["text"]
    assert all(r["n_chars"] == len(r["text"]) for r in kept.values())
    copies = Counter(r["doc_id"] for r in seen["source_mixing"])
    assert copies and max(copies.values()) <= 2
    packed = Counter(r["doc_id"] for r in seen["best_fit_packing"] if r["piece"] == 0)
    assert packed == copies
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(r["ids_crc32"] for r in whole.collect()) == sorted(r["ids_crc32"] for r in seen["best_fit_packing"])


def test_empty_clashing_and_repeated_rows(spark, tmp_path):
    """An empty table stays empty at every stage; clashing columns stay as they are, and of repeated rows with equal ids one is left."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, __s string, __g string, g string, m0 double, x0 double, `mix` string, `__id` long, `list` string"
    rnd = random.Random(2)
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(k, prose(rnd, 90, letters), "en", None, 1, "s", "g", "q", 1.0, 2.0, "m", 7, "l") for k in range(60)]
    full = spark.createDataFrame([*rows, rows[0], rows[0]], schema)
    for name, docs in (("empty", full.where("false")), ("full", full)):
        docs = docs.drop("mix")
        for stage_name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            path = str(tmp_path / name / stage_name)
            out.write.parquet(path)
            if stage_name != corpus_pipeline.STAGES[-1][0]:
                assert out.columns == docs.columns
                docs = spark.read.parquet(path)
                if name == "full" and stage_name in ("near_duplicates", "suffix_array_dedup"):
                    assert sorted(r["doc_id"] for r in docs.collect()) == list(range(60)) and {r["m0"] for r in docs.collect()} == {1.0}
        assert (spark.read.parquet(path).count() > 0) == (name == "full")
