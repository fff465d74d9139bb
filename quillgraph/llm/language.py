"""Language identification by partial matching: one variable-order byte context tree per language.

A tree counts which byte followed each context of up to three bytes. The code length of a byte in a context is
-log2(c / (n + d)) if the context has seen it, else -log2(d / (n + d)) for the escape plus its code length in the next
shorter context (n bytes seen, d distinct ones: escape method C); below the empty context, all 257 symbols are equally likely.
The counts are frozen after training, so code lengths are exact sums over table entries.
"""

from __future__ import annotations

import numpy as np
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

#: Bounds of the training sample, for each language: documents, and bytes of a document.
SAMPLE_DOCS, SAMPLE_BYTES = 600, 50_000
#: Longest contexts that are kept, over all languages together (the most frequent ones of each in turn; others fall back to two bytes).
CONTEXTS = 40_000


class Trees:
    """Code length tables of all languages. Bytes are numbered by those seen in training; 0 stands before a text, the last number for other bytes."""

    def __init__(self, samples: dict[str, list[bytes]], contexts: int = CONTEXTS):
        self.languages = sorted(samples)
        seen = np.zeros(256, bool)
        for texts in samples.values():
            for text in texts:
                seen[np.frombuffer(text, np.uint8)] = True
        self.width = a = int(seen.sum()) + 2
        self.rank = np.where(seen, np.cumsum(seen), a - 1).astype(np.int64)
        coded = {lang: np.concatenate([np.concatenate([np.zeros(3, np.int64), self.rank[np.frombuffer(t, np.uint8)]]) for t in texts]) for lang, texts in samples.items()}
        triples, place = np.zeros(a**3, np.int64), np.full(a**3, a**3, np.int64)  # place: the best among any language's contexts by count
        for x in coded.values():
            own = np.bincount((x[:-3] * a + x[1:-2]) * a + x[2:-1], minlength=a**3)
            used = np.flatnonzero(own)
            used = used[np.argsort(-own[used], kind="stable")]
            place[used] = np.minimum(place[used], np.arange(len(used)))
            triples += own
        used = np.flatnonzero(triples)
        kept = np.sort(used[np.lexsort((-triples[used], place[used]))][:contexts])
        #: Number of a three-byte context, or -1.
        self.slot = np.full(a**3, -1, np.int32)
        self.slot[kept] = np.arange(len(kept), dtype=np.int32)
        self.two = np.zeros((a * a * a, len(self.languages)), np.float32)
        self.three = np.zeros((len(kept) * a, len(self.languages)), np.float32)
        for k, lang in enumerate(self.languages):
            x = coded[lang]
            cost = np.full((1, a), np.log2(257.0))
            pair = x[:-1] * a + x[1:]
            for counts in (np.bincount(x[3:], minlength=a).reshape(1, a), np.bincount(pair, minlength=a * a).reshape(a, a), np.bincount(pair[:-1] * a + x[2:], minlength=a**3).reshape(a * a, a)):
                cost = self.extend(counts, cost[np.arange(len(counts)) % len(cost)])
            self.two[:, k] = cost.reshape(-1)
            s = self.slot[(x[:-3] * a + x[1:-2]) * a + x[2:-1]].astype(np.int64)
            counts = np.bincount((s * a + x[3:])[s >= 0], minlength=len(kept) * a).reshape(-1, a)
            self.three[:, k] = self.extend(counts, cost[kept % (a * a)]).reshape(-1)

    @staticmethod
    def extend(counts: np.ndarray, shorter: np.ndarray) -> np.ndarray:
        """Code lengths in contexts with these counts, given those in the contexts one byte shorter. What is no byte of a text is not learned."""
        counts = counts.astype(np.float64)
        counts[:, 0] = counts[:, -1] = 0
        n, d = counts.sum(1, keepdims=True), (counts > 0).sum(1, keepdims=True)
        with np.errstate(divide="ignore", invalid="ignore"):
            escaped = np.where(n > 0, shorter - np.log2(d / (n + d)), shorter)
            return np.where(counts > 0, -np.log2(counts / (n + d)), escaped)

    def lengths(self, text: bytes, chunk: int = 1 << 18) -> np.ndarray:
        """Bits that each language's tree needs for the whole text."""
        x = np.concatenate([np.zeros(3, np.int64), self.rank[np.frombuffer(text, np.uint8)]])
        a, total = self.width, np.zeros(len(self.languages))
        for low in range(0, len(text), chunk):
            part = x[low : low + chunk + 3]
            pair = part[1:-2] * a + part[2:-1]
            s = self.slot[part[:-3] * (a * a) + pair]
            known = s >= 0
            total += self.three[s[known].astype(np.int64) * a + part[3:][known]].sum(0, dtype=np.float64)
            total += self.two[(pair * a + part[3:])[~known]].sum(0, dtype=np.float64)
        return total


def train(labelled: DataFrame, docs: int = SAMPLE_DOCS, size: int = SAMPLE_BYTES, contexts: int = CONTEXTS, text: str = "text", lang: str = "lang", key: str = "doc_id") -> Trees:
    """Trees from a bounded sample: at most `docs` rows a language, chosen by a hash of their id, and `size` bytes of each,
    from a hashed place on if it is longer.

    Rows with a null text or language teach nothing. Counting languages is one aggregation; only the sample reaches the driver.
    """
    rows = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("t is not null and l is not null")
    totals = {r["l"]: r["n"] for r in rows.groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not totals:
        return Trees({})
    share = F.create_map(*[x for name, n in totals.items() for x in (F.lit(name), F.lit(min(1.0, docs / n)))])
    draw = F.pmod(F.xxhash64("k"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = rows.where(draw < share[F.col("l")]).withColumn("b", F.expr(f"substring(cast(t as binary), cast(1 + pmod(xxhash64(k, 'place'), greatest(octet_length(t) - {size}, 0) + 1) as int), {size})"))
    held: dict[str, list[tuple]] = {name: [] for name in totals}
    for r in sample.select("l", "b", draw.alias("draw")).toLocalIterator():
        held[r["l"]].append((r["draw"], bytes(r["b"])))
    return Trees({name: [b for _, b in sorted(x)[:docs]] for name, x in held.items()}, contexts)


def has_letter(text: bytes) -> bool:
    return text.isalpha() or any(c.isalpha() for c in text.decode("utf-8", "replace"))


def identify(docs: DataFrame, trees: Trees, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document: the language with the shortest code for the whole text, and its posterior probability.

    Ties go to the first language by name. Null texts, texts without a letter, and all texts if nothing was learned, are `und`
    with score 0. Repeated rows stay, ids may be null, an empty table gives an empty result; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(trees)  # bounded by `contexts` and the alphabet, not by the corpus

    def work(batches):
        model = shared.value
        for batch in batches:
            names, scores = [], []
            for value in common.as_bytes(batch.column(1)):
                if not value or not model.languages or not has_letter(value):
                    names.append("und")
                    scores.append(0.0)
                    continue
                bits = model.lengths(value)
                best = int(bits.argmin())
                names.append(model.languages[best])
                scores.append(float(1 / np.exp2(np.clip(bits[best] - bits, -1000, 0)).sum()))
            yield {"doc_id": pc.cast(batch.column(0), "int64"), "lang_pred": names, "score": scores}

    return common.map_batches(docs.select(key, text), work, "doc_id long, lang_pred string, score double")


def held_out(key: str, folds: int, fold: int):
    return F.coalesce(F.crc32(F.col(key).cast("string")) % folds == fold, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    trees = train(docs.where(~held_out("doc_id", 4, 2)))
    return identify(docs, trees).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", "score")


QUERIES = {"op8_language_id": op8_language_id}
SQL: dict[str, str] = {}
