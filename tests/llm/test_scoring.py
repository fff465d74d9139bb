"""License scan, language identification, mixing, quality and perplexity against plain implementations."""

import itertools
import math
import random
from pathlib import Path
from urllib.parse import urlparse
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

from quillgraph.llm import common, language, licenses, mixing, perplexity, quality


def prose(rnd, n, letters="abcdefg"):
    return " ".join("".join(rnd.choice(letters) for _ in range(rnd.randint(1, 6))) for _ in range(n))


def test_license_scan(spark):
    rnd = random.Random(1)
    mit = next(t for label, t in licenses.TEMPLATES if label == "mit" and len(t) > 100)
    broken = " ".join(w for k, w in enumerate(mit.split()) if k % 3)
    texts = ["The MIT License. mit-license MIT  license", "x" + mit.replace(" ", "\n"), prose(rnd, 300) + mit + prose(rnd, 300), broken, "cc  by", "apache", "Licensed under CC BY-NC 4.0.", "gnu general public license " * 3, "mitlicense mit. License"]
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert (got[0]["n_base"], got[0]["first_word"], got[0]["last_word"], got[0]["base_labels"]) == (3, 1, 5, "mit")
    assert got[1]["labels"] == got[2]["labels"] == "mit" and got[2]["score"] == 1 and got[2]["base_labels"] == ""
    assert got[3]["labels"] == "" and got[4]["base_labels"] == "cc-by" and got[5]["labels"] == ""
    assert got[6]["labels"] == "cc-by,cc-by-nc" and got[7]["n_base"] == 3 and got[7]["last_word"] == 8 and got[8]["n_base"] == 1
    for k, text in enumerate(texts):
        words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), text.encode()))
        assert got[k]["n_words"] == len(words)
        best = 0
        for _, notice in licenses.TEMPLATES:
            tokens = set(licenses.words_of(notice.encode()))
            width = max(math.ceil(0.9 * len(tokens) - 1e-9), 2 * len(tokens))
            share = max((len(tokens & set(words[i : i + width])) / len(tokens) for i in range(max(1, len(words) - width + 1))), default=0)
            best = max(best, share if share >= 0.9 - 1e-9 else 0)
        assert got[k]["score"] == pytest.approx(best)


def test_code_lengths():
    """Tables against a direct computation of escape method C."""
    rnd = random.Random(2)
    samples = {"x": [prose(rnd, 60, "abc").encode(), b"aab"], "y": [prose(rnd, 60, "bcd").encode()]}
    trees = language.Trees(samples)

    def bits(lang, text):
        data = b"".join(b"\0\0\0" + t for t in samples[lang])
        counts = [defaultdict(Counter) for _ in range(4)]
        for i in range(3, len(data)):
            for k in range(4):
                counts[k][data[i - k : i]][data[i]] += 1
        total, data = 0.0, b"\0\0\0" + text
        for i in range(3, len(data)):
            for k in (3, 2, 1, 0):
                seen = {s: c for s, c in counts[k][data[i - k : i]].items() if s} if data[i - k : i] in counts[k] else {}
                n, d = sum(seen.values()), len(seen)
                if data[i] in seen:
                    total -= math.log2(seen[data[i]] / (n + d))
                    break
                total -= math.log2(d / (n + d)) if n else 0
            else:
                total += math.log2(257)
        return total

    for text in (b"abc cba", prose(rnd, 30, "abcd").encode(), b"zz?!", b"a"):
        assert trees.lengths(text) == pytest.approx([bits("x", text), bits("y", text)], rel=1e-4)
        assert trees.lengths(text, chunk=4) == pytest.approx(trees.lengths(text), rel=1e-4)


def test_contexts_are_shared_by_languages():
    """A language of one short text keeps its contexts next to one with thousands of more frequent ones."""
    rnd = random.Random(20)
    trees = language.Trees({"large": [prose(rnd, 20_000).encode()], "small": [b"xyzzy zyx yxz"]}, contexts=30)
    held = lambda t: trees.slot[np.dot(trees.rank[list(t)], [trees.width**2, trees.width, 1])] >= 0
    assert all(held(t) for t in (b"xyz", b"yzz", b"zzy", b"zyx", b"zy ")) and (trees.slot >= 0).sum() == 30


def test_long_texts_are_sampled_from_any_place(spark):
    rows = [(k, "a" * 50 + "b" * 50 + "é" * 25, "x") for k in range(40)]
    trees = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), size=20)
    assert all(trees.rank[c] < trees.width - 1 for c in "abé".encode())


def test_language_accuracy(spark):
    rnd = random.Random(4)
    rows = [(k, prose(rnd, rnd.randint(5, 80), letters), letters) for k in range(120) for letters in ("abcdefgh", "efghijkl", "aeiouxyz")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    trees = language.train(df.where("doc_id % 2 = 0"))
    got = df.where("doc_id % 2 = 1").withColumnRenamed("lang", "true")
    named = language.identify(got.selectExpr("doc_id * 10 + length(true) doc_id", "text"), trees)
    assert named.count() == 180
    right = sum(trees.languages[int(trees.lengths(t.encode()).argmin())] == lang for k, t, lang in rows if k % 2)
    assert right >= 0.95 * 180


def test_targets_by_reshaping(spark):
    rnd = random.Random(5)
    sizes = {None: 40, **{f"s{k}": rnd.randint(0, 400) for k in range(9)}}
    rows = [(s, n) for s, n in sizes.items()]
    got = {r["source"]: r["target"] for r in mixing.targets(spark.createDataFrame(rows, "source string, size long")).collect()}
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    capped, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        unit = rest / sum(weight[s] for s in order if s not in capped)
        over = {s for s in order if s not in capped and weight[s] * unit >= 2 * sizes[s]}
        if not over:
            break
        capped |= over
    assert got == pytest.approx({s: 2 * sizes[s] if s in capped else weight[s] * unit for s in order})
    assert sum(got.values()) == pytest.approx(total)


def test_mix_comes_near_targets(spark):
    rnd = random.Random(6)
    rows = [(k, "w " * rnd.randint(1, 60), f"s{k % 4}") for k in range(6000)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    planned = mixing.plan_mix(df).select("source", "mix.*").toPandas()
    for _, part in planned.groupby("source"):
        assert (part["size"] * part["copies"]).sum() == pytest.approx(part["target"].iloc[0], rel=0.08)
    assert mixing.mix(df).count() == planned["copies"].sum()


def brute_statistics(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    counts = Counter(windows)
    covered = {j for i, w in enumerate(windows) if counts[w] > 1 for j in (i, i + 1, i + 2)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered))


def test_statistics(spark):
    rnd = random.Random(7)
    texts = [None, "", " \n ", "a", "a b", "a b c", "a b c a b c", "a a a a", "a a a", "x\ny\nx\n \nx", "# é|漢 <b>\x0b\x0c\r\nq"] + ["".join(rnd.choice("ab #\n\t|é") for _ in range(rnd.randint(1, 200))) for _ in range(60)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r[0]: tuple(r)[1:] for r in df.select("doc_id", quality.statistics().alias("s")).select("doc_id", "s.*").collect()}
    assert {k: v[:5] for k, v in got.items()} == {k: brute_statistics(t) for k, t in enumerate(texts)}
    for k, t in enumerate(texts):
        words = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        assert got[k][5:] == (sum(c in string.punctuation and c not in "\\" for c in t or ""), sum(c in string.ascii_uppercase for c in t or ""), len(set(words)))


def test_outliers(spark):
    rnd = random.Random(8)
    rows = [(k, prose(rnd, rnd.randint(60, 200)), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join("#$%|" * 3 + w for w in prose(rnd, 80).split()), "en", "s") for k in range(20)]
    rows += [(2000 + k, " ".join(w * 8 for w in prose(rnd, 80).split()), "en", "s") for k in range(20)]
    rows += [(3000, "#$%| " * 80, "xx", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    assert {r["doc_id"] for r in quality.keep_good(df).collect()} == set(range(300))


def test_small_groups_are_judged_by_a_wider_one(spark):
    """60 sources of 4 rows, a language of 3 rows and one of 1: every row has a distance, and junk is found in each."""
    rnd = random.Random(18)
    junk = lambda: " ".join("#$%|" * 3 + w for w in prose(rnd, 80).split())
    rows = [(k, prose(rnd, rnd.randint(60, 200)), "en", f"s{k % 60}") for k in range(240)]
    rows += [(1000 + k, junk(), "en", f"s{k}") for k in range(10)] + [(1010, junk(), "xx", "a"), (1011, junk(), None, None), (1012, "few words", "yy", "b")]
    rows += [(240 + k, prose(rnd, 90), "xx", "a") for k in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    stats = quality.with_statistics(df)
    fitted = quality.fit(stats)
    judged = quality.judge(stats, fitted, quality.cut_of(stats, fitted)).collect()
    assert all(r["__distance"] is not None for r in judged) and {r["doc_id"] for r in judged if r["__kept"]} == set(range(242))


def test_cut_between_clean_rows_and_table_lines(spark):
    """Lines of about 8% bars are well beyond clean ones, and are rejected."""
    rnd = random.Random(19)
    rows = [(k, prose(rnd, rnd.randint(60, 200)), "en", "s") for k in range(300)]
    rows += [(1000 + k, " ".join(w + "|" * (j % 3 == 0) for j, w in enumerate(prose(rnd, 90).split())), "en", "s") for k in range(15)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(4)
    stats = quality.with_statistics(df)
    fitted = quality.fit(stats)
    cut = quality.cut_of(stats, fitted)
    judged = quality.judge(stats, fitted, cut).collect()
    got = {r["doc_id"]: r["__distance"] for r in judged}
    assert max(got[k] for k in range(300)) < cut < min(got[1000 + k] for k in range(15))
    assert 1.5 < np.median([got[k] for k in range(300)]) < 5
    assert {r["doc_id"] for r in judged if r["__kept"]} == set(range(300))


def test_least_dense():
    low, high = (quality.chi_square_quantile(1 - t) for t in quality.TAILS)
    place = lambda d: math.floor(math.log(d) * quality.FINE)
    assert low < quality.least_dense({}) < high
    assert 15 < quality.least_dense({place(d): 5 for d in (11, 12, 13, 14, 25, 28, 30, 33, 36, 39, 42, 45, 48)}) < 24
    assert quality.least_dense({k: 2000 - 9 * k for k in range(60, 140)}) > 0.9 * high


def frame_of_vectors(spark, groups):
    rows = [(g, *map(float, r)) for g, x in groups.items() for r in x]
    return spark.createDataFrame(rows, "g string, x0 double, x1 double, x2 double, x3 double")


def test_estimate_of_clean_vectors(spark):
    """Centre and scatter of clean, correlated vectors with a third of gross outliers are those of the clean ones."""
    rng = np.random.default_rng(9)
    mix = rng.normal(size=(4, 4))
    clean = rng.normal(size=(3000, 4)) @ mix.T + 5
    far = rng.normal(size=(1500, 4)) + 60
    got = quality.estimate(frame_of_vectors(spark, {"g": np.vstack([clean, far])}), [1e-9] * 4).first()
    assert [got[f"m{i}"] for i in range(4)] == pytest.approx(clean.mean(0), abs=0.25)
    found = np.array([[got[f"c{max(i, j)}{min(i, j)}"] for j in range(4)] for i in range(4)])
    assert found == pytest.approx(np.cov(clean.T), rel=0.2, abs=0.4)


def test_least_determinant_of_small_groups(spark):
    """Against all subsets of half the rows: fewer than a twentieth have a lower determinant than the one reached, and outliers are far from it."""
    rng = np.random.default_rng(10)
    groups = {f"g{k}": np.vstack([rng.normal(size=(9, 4)) @ rng.normal(size=(4, 4)), rng.normal(size=(3, 4)) + 30 + 10 * k]) for k in range(6)}
    rows = frame_of_vectors(spark, groups)
    middle = quality.quartiles(rows)
    got = {r["g"]: r for r in quality.concentrate(rows, middle.select("g", "n"), middle, [1e-12] * 4).collect()}
    scale = quality.COVERAGE / quality.chi_square(quality.chi_square_quantile(quality.COVERAGE), 6)
    for g, x in groups.items():
        every = np.array([np.linalg.det(np.cov(x[list(s)].T, bias=True)) for s in itertools.combinations(range(12), 6)])
        found = np.prod([got[g][f"l{i}{i}"] for i in range(4)]) ** 2 / scale**4
        assert found > every.min() * 0.99 and (every < found * 0.99).mean() < 0.05
        low = np.array([[got[g][f"l{i}{j}"] if j <= i else 0 for j in range(4)] for i in range(4)])
        away = (np.linalg.solve(low, (x - [got[g][f"m{i}"] for i in range(4)]).T) ** 2).sum(0)
        assert away[:9].max() < away[9:].min()


def test_targets_bear_small_groups(spark):
    """A group of one outlying row is judged by its target, and hot keys beyond the sending bound give the same estimates."""
    rng = np.random.default_rng(11)
    rows = frame_of_vectors(spark, {"a": rng.normal(size=(400, 4)), "b": np.full((1, 4), 50.0)})
    target = spark.createDataFrame([(g, *[0.0] * 4, *[float(i == j) for i, j in quality.PAIRS]) for g in "ab"], ["g", *quality.CENTRE, *quality.SCATTER])
    sent = {r["g"]: r for r in quality.estimate(rows, [1e-3] * 4, target).collect()}
    assert abs(sent["b"]["m0"]) < 3 and sent["b"]["c00"] < 4 and sent["a"]["c00"] == pytest.approx(1, abs=0.2)
    most, quality.SENT_GROUPS = quality.SENT_GROUPS, 0
    try:
        dealt = {r["g"]: r for r in quality.estimate(rows, [1e-3] * 4, target).collect()}
    finally:
        quality.SENT_GROUPS = most
    assert all(list(dealt[g])[1:] == pytest.approx(list(sent[g])[1:]) for g in "ab")


def test_chi_square():
    assert quality.chi_square_quantile(0.95, 4) == pytest.approx(9.4877, abs=1e-3) and quality.chi_square_quantile(0.975, 6) == pytest.approx(14.4494, abs=1e-3)


def brute_model(train, texts):
    def toks(t):
        return [*re.sub("[A-Z]", lambda m: m[0].lower(), t or "").split(), None]

    uni, bi = Counter(), Counter()
    for t in train:
        x = toks(t)
        uni.update(x)
        bi.update(zip(["<s>", *x[:-1]], x, strict=True))
    n, v = sum(uni.values()), len(uni)
    after = Counter(w for _, w in bi)

    def discounts(counts):
        m = [sum(c == k for c in counts) for k in (1, 2, 3, 4)]
        return perplexity.discounts(*m)

    d2, d1 = discounts(bi.values()), discounts(after.values())
    total = Counter()
    rest = defaultdict(float)
    for (a, _), c in bi.items():
        total[a] += c
        rest[a] += d2[min(c, 3)]
    back = sum(d1[min(c, 3)] for c in after.values()) / len(bi)
    out = []
    for t in texts:
        x, s, base = toks(t), 0.0, 0.0
        for a, w in zip(["<s>", *x[:-1]], x, strict=True):
            low = max(after[w] - d1[min(after[w], 3)], 0) / len(bi) + back / (v + 1)
            c = bi[a, w]
            s += math.log10(max(c - d2[min(c, 3)], 0) / total[a] + rest[a] / total[a] * low if total[a] else low)
            base += math.log10((uni[w] + 0.5) / (n + 0.5 * (v + 1)))
        out.append((len(x), sum(uni[w] > 0 for w in x), n, base, s))
    return out


@pytest.mark.parametrize("shards", [1, 7, 300])
def test_kneser_ney(spark, shards):
    rnd = random.Random(10)
    words = [prose(rnd, 1) for _ in range(60)]
    text = lambda: " ".join(rnd.choice(words[: rnd.randint(2, 60)]) for _ in range(rnd.randint(0, 40)))
    train, other = [text() for _ in range(150)] + [None], [text() + " Unseen" for _ in range(30)] + [None, ""]
    model = perplexity.train(spark.createDataFrame([(t,) for t in train], "text string").repartition(4), shards=shards)
    every = train + other
    got = perplexity.score(spark.createDataFrame(list(enumerate(every)), "doc_id long, text string"), model).orderBy("doc_id").collect()
    for r, want in zip(got, brute_model(train, every), strict=True):
        assert tuple(r)[1:] == pytest.approx(want, rel=1e-9)


def test_probabilities_sum_to_one(spark):
    rnd = random.Random(11)
    words = ["a", "b", "c", "d"]
    train = [" ".join(rnd.choice(words) for _ in range(rnd.randint(1, 12))) for _ in range(80)]
    model = perplexity.train(spark.createDataFrame([(t,) for t in train], "text string"))
    hashes = perplexity._WORDS.of([w.encode() for w in words])
    for first in [*hashes, np.uint64(12345)]:
        total = 0.0
        for second in [*hashes, perplexity.END, np.uint64(999)]:  # the last stands for all unseen words
            pair = np.array([first, second])
            total += 10 ** (model.score(pair, np.array([2]))[2][0] - model.score(pair[:1], np.array([1]))[2][0])
        assert total == pytest.approx(1, abs=1e-9)


def test_estimates_take_few_queries(spark):
    ran = spark._jsparkSession.sharedState().statusStore().executionsCount
    rnd = random.Random(4)
    docs = spark.createDataFrame([(" ".join("".join(rnd.choices("abcdEF,", k=rnd.randint(2, 9))) for _ in range(120)), "en", f"s{k % 3}") for k in range(60)], "text string, lang string, source string")
    stats = common.cut(quality.with_statistics(docs).select("__s", "__g"))
    before = ran()
    assert quality.fit(stats, steps=2).count() > 0
    assert ran() - before < 35  # each leaves threads and blocks with the driver


def test_estimates_take_few_tasks(spark):
    """Aggregates of few rows take few tasks and files, however many partitions a shuffle has; the driver keeps something of each."""
    rnd = random.Random(6)
    docs = spark.createDataFrame([(" ".join("".join(rnd.choices("abcdEF,", k=rnd.randint(2, 9))) for _ in range(90)), "en", f"s{k % 5}") for k in range(100)], "text string, lang string, source string").repartition(2)
    stats = common.cut(quality.with_statistics(docs).select("__s", "__g"))
    held = {"spark.sql.shuffle.partitions": "60", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before, context = {k: spark.conf.get(k) for k in held}, spark.sparkContext
    written, tracker = len(common._PATHS), context.statusTracker()
    try:
        for k, v in held.items():
            spark.conf.set(k, v)
        context.setJobGroup("few tasks", "")
        fitted = quality.fit(stats, steps=2)
        judged = {tuple(r) for r in quality.judge(stats, fitted, quality.cut_of(stats, fitted)).collect()}
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        for k, v in before.items():
            spark.conf.set(k, v)
    stages = {s for job in tracker.getJobIdsForGroup("few tasks") for s in tracker.getJobInfo(job).stageIds}
    tasks = [info.numTasks for s in stages if (info := tracker.getStageInfo(s))]
    files = [p.name for path in common._PATHS[written:] for p in Path(urlparse(path).path).iterdir() if not p.name.startswith(".")]
    assert len(tasks) > 20 and len(files) < 60 and not any("SUCCESS" in f for f in files)
    assert sum(n > 10 for n in tasks) <= 12, sorted(tasks)
    assert len(judged) >= 90
