"""Interpolated modified Kneser-Ney bigram model: counted in Spark, kept as sorted hash arrays, memory-mapped by the workers.

Words are 64-bit hashes. Bigrams live in shards by their first word, so that a context's figures are complete in its shard; a word
with more than a shard's fair part of all tokens is spread over the shards by the second word, and its few partial figures are summed.
A shard is a file of sorted keys (shard number, 48 bits of hash) and a file of counts. Every count comes from all training rows.
"""

from __future__ import annotations

import json
import os
from collections import defaultdict
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common
from quillgraph.llm.language import held_out

#: Hashes of the marks before the first and after the last word; words hash elsewhere but for a chance of 2^-64.
BEGIN, END = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Tokens handled at once in a worker.
CHUNK = 1_500_000
ODD = np.uint64(0x9FB21C651E98DF25)

_WORDS = common.WordHashes()


def tokens(values: list[bytes | None]):
    """Groups of whole texts of about CHUNK tokens: lower-cased words and one end mark each, as hashes, with the length of each text."""
    parts, lengths, held = [], [], 0
    for value in values:
        words = (value or b"").lower().split()
        parts += [_WORDS.of(words), np.array([END])]
        lengths.append(len(words) + 1)
        held += lengths[-1]
        if held >= CHUNK:
            yield np.concatenate(parts), np.array(lengths)
            parts, lengths, held = [], [], 0
    if parts:
        yield np.concatenate(parts), np.array(lengths)


def contexts(words: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The word before each token; the begin mark for the first of a text."""
    before = np.empty_like(words)
    before[1:] = words[:-1]
    before[common.slices(lengths)[:-1]] = BEGIN
    return before


def scaled(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


@dataclass
class Layout:
    """Where keys live. `hot` are the sorted hashes of contexts that are spread over all shards."""

    path: str
    shards: int
    hot: np.ndarray = field(default_factory=lambda: np.empty(0, np.uint64))

    def word_keys(self, words: np.ndarray) -> np.ndarray:
        h = common.mix(words)
        return (scaled(h, self.shards) << np.uint64(48)) | (common.mix(h + ODD) >> np.uint64(16))

    def pair_keys(self, before: np.ndarray, words: np.ndarray) -> np.ndarray:
        h = common.mix(before * ODD + common.mix(words))
        place = common.mix(before)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, before), len(self.hot) - 1)
            place = np.where(self.hot[at] == before, common.mix(h ^ ODD), place)
        return (scaled(place, self.shards) << np.uint64(48)) | (h >> np.uint64(16))

    def file(self, kind: str, shard: int) -> str:
        return os.path.join(self.path, f"{kind}{shard}")


def counted(keys: np.ndarray, weights: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, the sum of weights of each, and the position of one row of each."""
    order = np.argsort(keys, kind="stable")
    ordered = keys[order]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(keys) else np.empty(0, np.int64)
    ones = np.ones(len(keys), np.int64) if weights is None else weights[order].astype(np.int64)
    return ordered[first], np.add.reduceat(ones, first) if len(first) else np.empty(0, np.int64), order[first]


def by_shard(keys: np.ndarray, shards: int) -> list[tuple[int, slice]]:
    """Slices of sorted keys by shard."""
    ends = np.searchsorted(keys, np.arange(1, shards + 1, dtype=np.uint64) << np.uint64(48)) if shards < 1 << 16 else np.searchsorted(keys >> np.uint64(48), np.arange(shards, dtype=np.uint64), "right")
    starts = np.concatenate([[0], ends[:-1]])
    return [(k, slice(a, b)) for k, (a, b) in enumerate(zip(starts, ends, strict=True)) if a < b]


def gathered(batches, *dtypes: str) -> dict[int, list[np.ndarray]]:
    """Arrays by shard from rows (shard, bytes, bytes, ...)."""
    found = defaultdict(lambda: [[] for _ in dtypes])
    for batch in batches:
        columns = [batch.column(k + 1).to_pylist() for k in range(len(dtypes))]
        for row, shard in enumerate(batch.column(0).to_pylist()):
            for k, dtype in enumerate(dtypes):
                found[shard][k].append(np.frombuffer(columns[k][row], dtype))
    return {shard: [np.concatenate(x) for x in parts] for shard, parts in found.items()}


def count_of_counts(counts: np.ndarray) -> list[int]:
    return [int((counts == k).sum()) for k in (1, 2, 3, 4)]


def count_words(texts: DataFrame, layout: Layout) -> DataFrame:
    """Write the counts of all tokens; one row a shard with totals, and a row for each word that may be hot."""

    def count(batches):
        for batch in batches:
            for words, _ in tokens(common.as_bytes(batch.column(0))):
                keys, n, at = counted(layout.word_keys(words))
                cuts = by_shard(keys, layout.shards)
                yield {"shard": [k for k, _ in cuts], "a": [words[at[s]].tobytes() for _, s in cuts], "b": [n[s].astype("u4").tobytes() for _, s in cuts]}

    def merge(batches):
        for shard, (words, n) in gathered(batches, "u8", "u4").items():
            keys, n, at = counted(layout.word_keys(words), n)
            common.write_whole(layout.file("uk", shard), keys)
            common.write_whole(layout.file("un", shard), n)
            often = np.flatnonzero(n * layout.shards >= n.sum())
            yield {"word": [None, *words[at[often]].astype(np.int64).tolist()], "n": [int(n.sum()), *n[often].tolist()], "distinct": [len(n), *[0] * len(often)]}

    parts = common.map_batches(texts, count, "shard int, a binary, b binary")
    return common.map_batches(parts.repartitionById(layout.shards, F.col("shard")), merge, "word long, n long, distinct long")


def count_pairs(texts: DataFrame, layout: Layout) -> DataFrame:
    """Write the counts of all bigrams and the figures of their contexts. Rows: partial figures of hot contexts, counts of counts
    (context null), and, for the lower order, how many distinct bigrams of the shard end in which word (`shard` set)."""

    def count(batches):
        for batch in batches:
            for words, lengths in tokens(common.as_bytes(batch.column(0))):
                before = contexts(words, lengths)
                keys, n, at = counted(layout.pair_keys(before, words))
                for shard, s in by_shard(keys, layout.shards):
                    first, second, m = before[at[s]], words[at[s]], n[s]
                    order = np.argsort(first, kind="stable")
                    distinct, runs, _ = counted(first)
                    yield {"shard": [shard], "a": [distinct.tobytes()], "b": [runs.astype("u4").tobytes()], "c": [second[order].tobytes()], "d": [m[order].astype("u4").tobytes()]}

    def merge(batches):
        for shard, held in runs_of(batches).items():
            first, second, n = (np.concatenate(x) for x in held)
            keys, n, at = counted(layout.pair_keys(first, second), n)
            first, second = first[at], second[at]
            common.write_whole(layout.file("bk", shard), keys)
            common.write_whole(layout.file("bn", shard), n.astype("u4"))
            context, total, _ = counted(first, n)
            place = np.searchsorted(context, first)
            figures = np.stack([total, *(np.bincount(place[low(n)], minlength=len(context)) for low in (lambda x: x == 1, lambda x: x == 2, lambda x: x > 2))], 1).astype(np.int64)
            hot = np.isin(context, layout.hot)
            own = common.mix(context[~hot])
            order = np.argsort(own)
            common.write_whole(layout.file("ck", shard), own[order])
            common.write_whole(layout.file("cf", shard), figures[~hot][order])
            rows = [(None, None, None, None, *count_of_counts(n)), *((None, None, None, int(c), *map(int, f)) for c, f in zip(context[hot].astype(np.int64), figures[hot], strict=True))]
            ends, m, at = counted(layout.word_keys(second))
            rows += [(k, second[at[s]].tobytes(), m[s].astype("u4").tobytes(), None, 0, 0, 0, 0) for k, s in by_shard(ends, layout.shards)]
            yield dict(zip(("shard", "a", "b", "context", "f0", "f1", "f2", "f3"), map(list, zip(*rows, strict=True)), strict=True))

    def runs_of(batches):
        found = defaultdict(lambda: [[], [], []])
        for batch in batches:
            for shard, a, b, c, d in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
                found[shard][0].append(np.repeat(np.frombuffer(a, "u8"), np.frombuffer(b, "u4")))
                found[shard][1].append(np.frombuffer(c, "u8"))
                found[shard][2].append(np.frombuffer(d, "u4"))
        return found

    parts = common.map_batches(texts, count, "shard int, a binary, b binary, c binary, d binary")
    return common.map_batches(parts.repartitionById(layout.shards, F.col("shard")), merge, "shard int, a binary, b binary, context long, f0 long, f1 long, f2 long, f3 long")


def count_continuations(ends: DataFrame, layout: Layout) -> DataFrame:
    """Write, for each word, how many distinct words it follows."""

    def merge(batches):
        for shard, (words, n) in gathered(batches, "u8", "u4").items():
            keys, n, _ = counted(layout.word_keys(words), n)
            common.write_whole(layout.file("vk", shard), keys)
            common.write_whole(layout.file("vn", shard), n)
            yield {"total": [int(n.sum())], **{f"f{k}": [x] for k, x in enumerate(count_of_counts(n))}, "more": [int((n > 2).sum())]}

    return common.map_batches(ends.repartitionById(layout.shards, F.col("shard")), merge, "total long, f0 long, f1 long, f2 long, f3 long, more long")


def discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """Discounts of counts 0, 1, 2 and over 2, by the usual estimates; with too few counts for them, half a count or less."""
    if not (n1 and n2 and n3):
        return np.array([0.0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    return np.clip([0.0, 1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3], [0, 0.05, 0.05, 0.05], [0, 0.95, 1.95, 2.95])


@dataclass
class Model:
    """Totals and discounts, and the layout of the mapped files. Small: what is sent to workers has at most a row for each shard."""

    layout: Layout
    tokens: int
    distinct: int
    pair_discounts: np.ndarray
    word_discounts: np.ndarray
    followed: int  # distinct bigrams
    word_backoff: float  # share of the uniform distribution in the lower order
    hot_figures: np.ndarray  # of layout.hot

    def __post_init__(self):
        self._files: dict[str, np.ndarray] = {}

    def __getstate__(self):
        return self.__dict__ | {"_files": {}}

    def _array(self, kind: str, shard: int, dtype: str) -> np.ndarray:
        name = self.layout.file(kind, shard)
        if name not in self._files:
            self._files[name] = common.mapped(name, dtype) if os.path.exists(name) else np.empty(0, dtype)
        return self._files[name]

    def _values(self, keys: np.ndarray, cuts: list[tuple[int, slice]], kind: str, value: str, dtype: str) -> np.ndarray:
        """Values of sorted keys, 0 where a key is not held."""
        out = np.zeros(len(keys), np.int64)
        for shard, s in cuts:
            held = self._array(kind + "k", shard, "u8")
            if len(held):
                at = np.minimum(np.searchsorted(held, keys[s]), len(held) - 1)
                out[s] = np.where(held[at] == keys[s], self._array(kind + value, shard, dtype)[at], 0)
        return out

    def _figures(self, context: np.ndarray) -> np.ndarray:
        """Total count, and how many words follow once, twice and more often, for distinct contexts."""
        h = common.mix(context)
        order = np.argsort(h)
        ordered, out = h[order], np.zeros((len(h), 4), np.int64)
        shards = scaled(ordered, self.layout.shards)
        for shard in np.unique(shards):
            s = slice(*np.searchsorted(shards, [shard, shard + np.uint64(1)]))
            held = self._array("ck", int(shard), "u8")
            if len(held):
                at = np.minimum(np.searchsorted(held, ordered[s]), len(held) - 1)
                out[order[s]] = np.where((held[at] == ordered[s])[:, None], self._array("cf", int(shard), "i8").reshape(-1, 4)[at], 0)
        if len(self.layout.hot):
            at = np.minimum(np.searchsorted(self.layout.hot, context), len(self.layout.hot) - 1)
            out = np.where((self.layout.hot[at] == context)[:, None], self.hot_figures[at], out)
        return out

    def score(self, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text: known tokens, log10 under smoothed counts of single tokens, log10 under the model."""
        before = contexts(words, lengths)
        starts = common.slices(lengths)[:-1]
        keys, back = np.unique(self.layout.word_keys(words), return_inverse=True)
        cuts = by_shard(keys, self.layout.shards)
        seen = self._values(keys, cuts, "u", "n", "i8")
        after = self._values(keys, cuts, "v", "n", "i8")
        d = self.word_discounts
        lower = self.word_backoff / (self.distinct + 1) + np.maximum(after - d[np.minimum(after, 3)], 0) / max(self.followed, 1)
        base = np.log10((seen + 0.5) / (self.tokens + 0.5 * (self.distinct + 1)))[back]
        distinct, place = np.unique(before, return_inverse=True)
        total, once, twice, more = self._figures(distinct).T.astype(np.float64)
        d = self.pair_discounts
        kept = np.where(total > 0, (d[1] * once + d[2] * twice + d[3] * more) / np.maximum(total, 1), 1.0)[place]
        pairs, again = np.unique(self.layout.pair_keys(before, words), return_inverse=True)
        n = self._values(pairs, by_shard(pairs, self.layout.shards), "b", "n", "u4")[again]
        higher = np.maximum(n - d[np.minimum(n, 3)], 0) / np.maximum(total, 1)[place]
        return np.add.reduceat((seen > 0)[back].astype(np.int64), starts), np.add.reduceat(base, starts), np.add.reduceat(np.log10(higher + kept * lower[back]), starts)


def train(docs: DataFrame, text: str = "text", shards: int | None = None) -> Model:
    """Count every row of `docs` (null texts: the end mark alone) and return the model. The files stay in the shared folder."""
    spark, texts = docs.sparkSession, docs.select(text)
    shards = shards or min(max(8, 2 * texts.rdd.getNumPartitions()), 65_535)
    layout = Layout(common.shared_path(spark, "bigrams"), shards)
    words = common.cut(count_words(texts, layout))
    n, distinct = words.where("word is null").agg(F.sum("n"), F.sum("distinct")).first()
    n, distinct = n or 0, distinct or 0
    hot = words.where(F.col("word").isNotNull() & (F.col("n") * shards >= n)).select("word").collect()  # at most one a shard
    begun = int(BEGIN) - (1 << 64)
    layout.hot = np.unique(np.array([begun, *(r[0] for r in hot)], np.int64).astype(np.uint64))
    pairs = common.cut(count_pairs(texts, layout))
    figures = pairs.where("shard is null").groupBy("context").agg(*[F.sum(f"f{k}").alias(f"f{k}") for k in range(4)]).collect()
    by_context = {r["context"]: [r["f0"], r["f1"], r["f2"], r["f3"]] for r in figures}
    below = count_continuations(pairs.where("shard is not null").select("shard", "a", "b"), layout)
    total = below.agg(*[F.sum(c).alias(c) for c in below.columns]).first().asDict()
    total = {k: v or 0 for k, v in total.items()}
    d = discounts(*(total[f"f{k}"] for k in range(4)))
    held_back = d[1] * total["f0"] + d[2] * total["f1"] + d[3] * total["more"]
    hot_figures = np.array([by_context.get(int(c), [0, 0, 0, 0]) for c in layout.hot.astype(np.int64)], np.int64)
    with open(os.path.join(layout.path, "totals.json"), "w") as out:
        json.dump({"tokens": n, "distinct": distinct, "shards": shards, "bigrams": total["total"]}, out)
    return Model(layout, n, distinct, discounts(*by_context.get(None, [0, 0, 0, 0])), d, total["total"], held_back / total["total"] if total["total"] else 1.0, hot_figures)


def score(docs: DataFrame, model: Model, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with token counts, the base score and the model's log10 probability of the whole text.

    A null or empty text is its end mark alone. Repeated rows are scored alike, ids may be null, an empty table gives an empty
    result, a model without training rows gives the uniform distribution. No other column is read.
    """

    def work(batches):
        for batch in batches:
            at = 0
            for words, lengths in tokens(common.as_bytes(batch.column(1))):
                known, base, full = model.score(words, lengths)
                yield {"doc_id": batch.column(0).slice(at, len(lengths)).cast(pa.int64()), "n_tokens": lengths, "n_known": known, "train_tokens": np.full(len(lengths), model.tokens), "base_score": base, "score": full}
                at += len(lengths)

    return common.map_batches(docs.select(key, text), work, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op4_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 1)
    scored = score(docs, train(docs.where(~out)))
    return scored.select("doc_id", out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


QUERIES = {"op4_kneser_ney": op4_kneser_ney}
SQL: dict[str, str] = {}
