"""Best-fit packing of tokenised documents into fixed-length sequences, improved by a swap-based local search."""

from __future__ import annotations

import heapq
import json
import re
import zlib
from collections.abc import Callable, Iterable, Iterator
from itertools import compress, pairwise
from operator import add

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

CAPACITY = 4096
END_ID = 1
#: Stands between words that are encoded together: a character that the tokenizer makes a token of its own. Words of one such text.
MARK, LINE = "\x01", 200
#: Texts that are taken out of a batch and split into words at once, and those whose ids are brought together at once.
TEXTS, JOINED = 1024, 128
#: Words that keep one token group of letters whatever follows: these are composed already, and each has one lower-case form of its own.
LETTERS = re.compile(r"[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Marks at the end of a word that are a token group of their own after a letter. Not among them are those of contractions and special tokens.
ENDING = b".,;:!?*$#&%()\"-"
END_OF_WORD = "</w>"
#: The normalizer and the splitting for which `LETTERS` and `ENDING` hold.
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]
SPLIT = {
    "type": "Split",
    "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
    "behavior": "Removed",
    "invert": True,
}
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


class Vocabulary:
    """Token ids of whole texts, word by word.

    The tokenizer drops white space and no merge crosses it, so the ids of a text are those of its words in order.
    Distinct words are remembered as packed little-endian ids. Beyond `bound` words a new memory is begun, into which words of the one
    before are taken over when they are met again, so frequent words are encoded once and at most two memories are held.
    Where the tokenizer is known to make groups of letters and of marks (`LETTERS`, `ENDING`), a word of letters with marks behind it has
    the ids of its lower-case letters and then those of the marks, which are remembered as words too; letters skip the normalizer.
    """

    def __init__(self, path: str, bound: int = 250_000):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known, self.before, self.bound = Tokenizer.from_file(path), {b"": b""}, {}, bound
        alone = self.tokenizer.encode(MARK, add_special_tokens=False).ids
        self.mark = alone[0] if len(alone) == 1 else None
        self.plainer = self.ends = None
        if letters_apart(json.loads(self.tokenizer.to_str())):
            from tokenizers import pre_tokenizers

            self.plainer = Tokenizer.from_file(path)
            self.plainer.normalizer = None
            self.plainer.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
            ids = self.tokenizer.get_vocab(with_added_tokens=True)
            self.ends = np.zeros(max(ids.values()) + 1, bool)
            self.ends[[at for token, at in ids.items() if token.endswith(END_OF_WORD)]] = True

    def plain(self, words: list[str]) -> list[bytes]:
        return [np.array(c.ids, "<u4").tobytes() for c in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def encode(self, words: list[str]) -> list[bytes]:
        """Packed ids of each word. Words are encoded LINE at a time as one text, with a mark between them whose id tells them apart; where
        a word brings that id itself, they are encoded one by one."""
        if self.mark is None:
            return self.plain(words)
        lines, out = [words[at : at + LINE] for at in range(0, len(words), LINE)], []
        for line, coded in zip(lines, self.tokenizer.encode_batch_fast([f" {MARK} ".join(line) for line in lines], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            ends = [*(4 * np.flatnonzero(ids == self.mark)).tolist(), ids.nbytes]
            if len(ends) == len(line):
                packed = ids.tobytes()
                out += [packed[a:b] for a, b in zip([0, *[e + 4 for e in ends]], ends, strict=False)]
            else:
                out += self.plain(line)
        return out

    def encode_letters(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words of lower-case `LETTERS`: LINE at a time as one text, told apart by tokens that end a word."""
        lines, out = [words[at : at + LINE] for at in range(0, len(words), LINE)], []
        for line, coded in zip(lines, self.plainer.encode_batch_fast([b" ".join(line).decode() for line in lines], add_special_tokens=False), strict=True):
            ids = np.array(coded.ids, "<u4")
            packed, ends = ids.tobytes(), (4 * np.flatnonzero(self.ends[ids]) + 4).tolist()
            out += [packed[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)]
            if len(ends) != len(line):
                raise ValueError(f"{len(line)} words were encoded as {len(ends)}")
        return out

    def fresh(self, words: Iterable[bytes]) -> list[bytes]:
        """Those of some distinct words that neither memory has; what only the one before has is taken over."""
        known, before = self.known, self.before
        new = [w for w in words if w not in known]
        again = [w for w in new if w in before]
        known.update(zip(again, map(before.__getitem__, again), strict=True))
        return [w for w in new if w not in before] if again else new

    def remember(self, words: Iterable[bytes]) -> None:
        """Take distinct words over from the memory before, as far as it has them, and encode the others."""
        whole, known = self.fresh(words), self.known
        if self.plainer:
            stems = [w.rstrip(ENDING) for w in whole]
            lower = [s.lower() if s.isalpha() else lower_letters(s) for s in stems]  # bytes that are letters by `isalpha` are ASCII
            marks = [w[len(s) :] for w, s in zip(whole, stems, strict=True)]
            apart = [x is not None for x in lower]
            composed, lower, marks = (list(compress(x, apart)) for x in (whole, lower, marks))
            whole = [w for w, x in zip(whole, apart, strict=True) if not x]
            self.encode_new(self.fresh(set(lower)), self.encode_letters)
        self.encode_new(whole, lambda part: self.encode([w.decode("utf-8", "replace") for w in part]))
        if self.plainer:
            self.encode_new(self.fresh(set(marks)), lambda part: self.encode([w.decode() for w in part]))
            known.update(zip(composed, map(add, map(known.__getitem__, lower), map(known.__getitem__, marks)), strict=True))

    def encode_new(self, words: list[bytes], encode: Callable[[list[bytes]], list[bytes]]) -> None:
        for at in range(0, len(words), 50_000):
            part = words[at : at + 50_000]
            self.known.update(zip(part, encode(part), strict=True))

    def ids(self, texts: list[bytes | None]) -> Iterator[bytes]:
        for low in range(0, len(texts), TEXTS):
            yield from self.packed(pa.array(texts[low : low + TEXTS], pa.large_binary()))

    def packed(self, texts: pa.Array) -> Iterator[bytes]:
        """Packed ids of each of some texts (strings or their bytes; null: none)."""
        texts = texts.cast(pa.large_binary())
        texts = pa.Array.from_buffers(pa.large_string(), len(texts), texts.buffers(), offset=texts.offset)
        split = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
        words = split.flatten().dictionary_encode()
        bounds, at = common.slices(pc.list_value_length(split).to_numpy()), words.indices.to_numpy()
        distinct = sliced(words.dictionary)
        del split, words
        self.remember(distinct)
        coded = list(map(self.known.__getitem__, distinct))
        if len(self.known) > self.bound:
            self.known, self.before = {b"": b""}, self.known
        lengths = np.fromiter(map(len, coded), np.int64, len(coded)) // 4
        starts, every = common.slices(lengths)[:-1], np.frombuffer(b"".join(coded), "<u4")
        for low in range(0, len(bounds) - 1, JOINED):
            ends = bounds[low : low + JOINED + 1]
            some = at[ends[0] : ends[-1]]
            counts = lengths[some]
            joined = every[common.ranges(starts[some], counts)].tobytes()
            places = (4 * common.slices(counts)[ends - ends[0]]).tolist()
            for a, b in pairwise(places):
                yield joined[a:b]


def letters_apart(tokenizer: dict) -> bool:
    """Whether a tokenizer (as read from JSON) lower-cases texts and splits them so that `LETTERS` and `ENDING` hold, and marks ends of words."""
    given, steps, model = ((tokenizer.get(part) or {}) for part in ("normalizer", "pre_tokenizer", "model"))
    steps = steps.get("pretokenizers") or [{}]
    apart = steps[0] == SPLIT and [s.get("type") for s in steps[1:]] == ["ByteLevel"] and not steps[1].get("add_prefix_space") and not steps[1].get("use_regex")
    plain = not any(LETTERS(t["content"].strip(ENDING.decode())) or t["normalized"] or t["lstrip"] or t["rstrip"] for t in tokenizer["added_tokens"])
    return apart and plain and given.get("normalizers") == NORMALIZERS and model.get("type") == "BPE" and model.get("end_of_word_suffix") == END_OF_WORD and not model.get("dropout")


def sliced(strings: pa.Array) -> list[bytes]:
    """The bytes of an array of large strings that has no offset and no nulls, as `to_pylist` of its bytes but several times as fast."""
    _, ends, data = strings.buffers()
    data = data.to_pybytes() if data else b""
    return [data[a:b] for a, b in pairwise(np.frombuffer(ends, np.int64, len(strings) + 1).tolist())] if len(strings) else []


def lower_letters(word: bytes) -> bytes | None:
    """A word of `LETTERS`, not all of them ASCII, in lower case; else none."""
    return None if word.isascii() else text.lower().encode() if LETTERS(text := word.decode("utf-8", "replace")) else None


_VOCABULARIES: dict[str, Vocabulary] = {}


def vocabulary(path: str) -> Vocabulary:
    """One per worker and file."""
    if path not in _VOCABULARIES:
        _VOCABULARIES[path] = Vocabulary(path)
    return _VOCABULARIES[path]


def tokenise(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID, text: str = "text", key: str = "doc_id") -> DataFrame:
    """A row for each piece of at most `capacity` ids; a null or empty text is the end id alone."""

    def work(batches):
        words, end = vocabulary(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = {name: [] for name in ("doc_id", "piece", "start", "length", "ids_crc32")}
            for low in range(0, batch.num_rows, TEXTS):
                few = batch.slice(low, TEXTS)
                for doc, ids in zip(few.column(0).to_pylist(), words.packed(few.column(1)), strict=True):
                    ids += end
                    for piece, at in enumerate(range(0, len(ids), 4 * capacity)):
                        part = ids[at : at + 4 * capacity]
                        for name, value in zip(out, (doc, piece, at // 4, len(part) // 4, zlib.crc32(part)), strict=True):
                            out[name].append(value)
            yield out

    return common.map_batches(docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")), work, PIECES)


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: positions of `lengths` by bin. A bit per free space finds the tightest bin in a few machine words."""
    free: dict[int, list[int]] = {}
    bins: list[list[int]] = []
    spaces = 0
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        size = lengths[item]
        fitting = spaces >> size
        if fitting:
            space = size + (fitting & -fitting).bit_length() - 1
            at = free[space].pop()
            if not free[space]:
                spaces ^= 1 << space
        else:
            space, at = capacity, len(bins)
            bins.append([])
        bins[at].append(item)
        if rest := space - size:
            free.setdefault(rest, []).append(at)
            spaces |= 1 << rest
    return bins


def _groups(members: list[int], lengths: list[int]) -> tuple[dict[int, tuple[int, ...]], dict[int, tuple[int, ...]]]:
    """Single items and pairs of a bin by their length; of those with equal length one stands for all."""
    kinds: dict[int, list[int]] = {}
    for i in members:
        kinds.setdefault(lengths[i], []).append(i)
    sizes = list(kinds)
    pairs = {2 * n: (same[0], same[1]) for n, same in kinds.items() if len(same) > 1}
    for a, n in enumerate(sizes):
        for m in sizes[:a]:
            pairs[n + m] = (kinds[n][0], kinds[m][0])
    return {n: (same[0],) for n, same in kinds.items()}, pairs


class _Offers:
    """For each length, the bins that have such a single item or pair, the emptiest first; a bit per length that is offered."""

    def __init__(self):
        self.heaps: dict[int, list[tuple[int, int, int]]] = {}
        self.bits = 0

    def add(self, size: int, entry: tuple[int, int, int]) -> None:
        heapq.heappush(self.heaps.setdefault(size, []), entry)
        self.bits |= 1 << size

    def find(self, above: int, up_to: int, target: int, fill: int, version: list[int]) -> tuple[int, int] | None:
        """The greatest length in (above, up_to] that a bin other than `target`, no fuller than `fill`, offers, and that bin."""
        left = self.bits & ((1 << (up_to + 1)) - 1)
        while (size := left.bit_length() - 1) > above:
            heap, own = self.heaps[size], None
            while heap and (heap[0][2] != version[heap[0][1]] or heap[0][1] == target):
                entry = heapq.heappop(heap)
                if entry[2] == version[target] and entry[1] == target:
                    own = entry
            found = heap[0] if heap else None
            if own:
                heapq.heappush(heap, own)
            if found and found[0] <= fill:
                return size, found[1]
            if not heap:
                self.bits ^= 1 << size
            left ^= 1 << size
        return None


def improve(bins: list[list[int]], lengths: list[int], capacity: int) -> list[list[int]]:
    """Local search over all underfull bins: a bin takes one or two items of an emptier one, for up to two of its own (three items in
    all), so that it gains the most within its gap. That raises the sum of squared fills (an integer with an upper bound, so it ends);
    emptied bins are dropped. It ends where no bin finds an exchange with any other, or where the bins are as few as their
    items' total length allows."""
    bins = [list(b) for b in bins]
    fill = [sum(lengths[i] for i in b) for b in bins]
    version, groups = [0] * len(bins), {}
    single, double = _Offers(), _Offers()
    used, least = sum(n > 0 for n in fill), -(-sum(fill) // capacity)

    def offer(b: int) -> None:
        version[b] += 1
        groups.pop(b, None)
        if 0 < fill[b] < capacity:
            groups[b] = _groups(bins[b], lengths)
            for offers, by_size in zip((single, double), groups[b], strict=True):
                for size in by_size:
                    offers.add(size, (fill[b], b, version[b]))

    def exchange(target: int) -> tuple[int, tuple[int, ...], tuple[int, ...]] | None:
        """The source, the items given to it and those taken from it."""
        gap, best, found = capacity - fill[target], 0, None
        ones, twos = groups[target]
        for given, kinds in (({0: ()}, (single, double)), (ones, (single, double)), (twos, (single,))):
            for size, give in given.items():
                for offers in kinds:
                    if got := offers.find(size + best, size + gap, target, fill[target], version):
                        best, found = got[0] - size, (got[1], give, groups[got[1]][offers is double][got[0]])
                        if best == gap:
                            return found
        return found

    if used > least:
        for b in range(len(bins)):
            offer(b)
    changed = True
    while changed and used > least:
        changed = False
        for target in sorted(groups, key=lambda b: (-fill[b], b)):
            while used > least and target in groups and (change := exchange(target)):
                source, give, take = change
                gain = sum(lengths[i] for i in take) - sum(lengths[i] for i in give)
                bins[target] = [i for i in bins[target] if i not in give] + list(take)
                bins[source] = [i for i in bins[source] if i not in take] + list(give)
                fill[target] += gain
                fill[source] -= gain
                used -= not bins[source]
                offer(target)
                offer(source)
                changed = True
    return [b for b in bins if b]


def pack(pieces: DataFrame, capacity: int = CAPACITY, block: int = 200_000) -> DataFrame:
    """Give each piece a sequence and a place in it.

    Pieces are dealt out evenly by content (no key can be hot) and packed within a task, in blocks of at most `block` pieces,
    so memory does not grow with the input; each block leaves at most one sequence that could have been shared with another.
    """

    def work(batches):
        context = TaskContext.get()
        made, held, kept = (context.partitionId() if context else 0) << 36, [], 0

        def flush():
            nonlocal made, held, kept
            t = pa.Table.from_batches(held).sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending"), ("ids_crc32", "ascending")])
            lengths = t.column("length").to_pylist()
            sequence, offset = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)
            for members in improve(best_fit(lengths, capacity), lengths, capacity):
                at = 0
                for item in members:
                    sequence[item], offset[item] = made, at
                    at += lengths[item]
                made += 1
            held, kept = [], 0
            yield from t.append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).combine_chunks().to_batches()

        for batch in batches:
            held.append(batch)
            kept += batch.num_rows
            if kept >= block:
                yield from flush()
        if kept:
            yield from flush()

    return common.map_batches(common.spread(pieces, "doc_id", "piece", "ids_crc32"), work, PACKED)


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Pack `docs` (doc_id, text; further columns are ignored) into sequences of at most `capacity` tokens.

    One row per piece. Null ids stay null, a null or empty text is its end token, repeated rows are packed once each,
    an empty table gives an empty result. Texts longer than a sequence, and only those, are cut.
    """
    return pack(tokenise(docs, tokenizer_path, capacity, end_id), capacity)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(common.table(spark, sf_dir, "documents"), default_tokenizer())


QUERIES = {"op5_best_fit_packing": op5_best_fit_packing}
SQL: dict[str, str] = {}
