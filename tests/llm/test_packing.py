"""Packing: exact ids, gapless sequences, and few of them."""

import random
import zlib
from collections import defaultdict
from itertools import combinations

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from quillgraph.llm import packing


def test_round_trip(spark):
    rnd = random.Random(3)
    texts = [" ".join(rnd.choice(["the", "Quick", "brown-fox", "jumped!", "ÉTÉ", "ǅ", "I'll", "<|endoftext|>", "x" * 30]) for _ in range(rnd.randint(0, 900))) for _ in range(80)] + [None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    path = packing.default_tokenizer()
    tokenizer = Tokenizer.from_file(path)
    rows = packing.pack_documents(df, path, capacity=512).collect()
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for k, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 1], "<u4").tobytes()
        pieces = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == list(range(0, len(ids) // 4, 512))
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(ids[4 * r["start"] : 4 * (r["start"] + r["length"])]) for r in pieces]
    for parts in by_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 512


def test_words_are_encoded_together():
    words = packing.Vocabulary(packing.default_tokenizer(), bound=300)
    asked, one = [], words.tokenizer

    class Counting:
        def encode_batch_fast(self, texts, **rest):
            asked.append(len(texts))
            return one.encode_batch_fast(texts, **rest)

    words.tokenizer = Counting()
    rnd = random.Random(5)
    odd = ["a\x01b", "\x01", "\x01\x01", "\u0301x", "e\u0301", "\u00a0", "x\u00a0y", "\u3000", "İ", "Σας", "<|endoftext|>", "x<|startoftext|>y", "'s", "don't", "12a", "日本", "🙂🙂", "\u200b", "ﬁ"]
    plain = ["".join(rnd.choices("abcdeäé-7,", k=rnd.randint(1, 9))) for _ in range(2000)]
    texts = [" ".join(rnd.sample(plain, 400)) for _ in range(300)]
    each = lambda text: np.array(one.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert list(words.ids([t.encode() for t in texts])) == list(map(each, texts))
    assert sum(asked) < 50  # not a text for each word
    mixed = [" ".join(rnd.sample(odd + plain[:20], 15)) for _ in range(300)]
    assert list(words.ids([t.encode() for t in mixed])) == list(map(each, mixed))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=120))
def test_bins_hold_everything_once(lengths):
    bins = packing.improve(packing.best_fit(lengths, 100), lengths, 100)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    assert all(sum(lengths[i] for i in b) <= 100 for b in bins)
    assert len(bins) <= len(packing.best_fit(lengths, 100))


def test_local_search_empties_a_bin():
    lengths = [6, 6, 4, 4, 3, 3, 3, 1]
    start = [[0, 4], [1, 5], [2, 3], [6, 7]]  # 9, 9, 8 and 4 of 10: three bins are enough
    assert len(packing.improve(start, lengths, 10)) == 3


def test_local_search_sees_all_bins():
    """The emptiest 40 bins of 97 allow no exchange among themselves; the tokens they need are in fuller bins."""
    lengths = [97] * 40 + [50, 48] * 30 + [52, 47] * 30
    start = [[k] for k in range(40)] + [[k, k + 1] for k in range(40, 160, 2)]  # 60 bins of 98 and 99: 50 + 50, 52 + 48 and 47 + 47 fit better
    fills = [sum(lengths[i] for i in b) for b in packing.improve(start, lengths, 100)]
    assert sum(f * f for f in fills) > sum(sum(lengths[i] for i in b) ** 2 for b in start) and fills.count(100) >= 30


def test_no_exchange_is_left():
    """Where the search ends above the least possible number of bins, no move, swap or exchange of two for one fills any bin further."""
    rnd = random.Random(12)
    lengths = [rnd.randint(21, 60) for _ in range(400)]
    bins = [[lengths[i] for i in b] for b in packing.improve(packing.best_fit(lengths, 100), lengths, 100)]
    assert len(bins) > -(-sum(lengths) // 100)
    some = lambda b, most: [c for k in range(most + 1) for c in combinations(b, k)]
    for into in bins:
        for out_of in bins:
            if into is not out_of and sum(out_of) <= sum(into):
                assert not any(0 < sum(take) - sum(give) <= 100 - sum(into) for give in some(into, 2) for take in some(out_of, 2) if len(give) + len(take) <= 3)


@settings(max_examples=80, deadline=None)
@given(st.text(max_size=80))
def test_ids_by_word_are_ids_of_the_text(text):
    vocabulary = packing.vocabulary(packing.default_tokenizer())
    got = np.frombuffer(next(vocabulary.ids([text.encode("utf-8", "ignore")])), "<u4").tolist()
    assert got == vocabulary.tokenizer.encode(text.encode("utf-8", "ignore").decode(), add_special_tokens=False).ids


def test_remembered_words():
    """A memory of few words, given up again and again, gives the ids of whole texts."""
    texts = [" ".join(f"w{(k * j) % 23}é" for j in range(40)).encode() for k in range(600)]
    small, whole = packing.Vocabulary(packing.default_tokenizer(), bound=5), packing.Vocabulary(packing.default_tokenizer())
    got = list(small.ids([*texts, None, b"", b" \n"]))
    assert got == list(whole.ids([*texts, None, b"", b" \n"])) and got[-3:] == [b"", b"", b""] and small.before
    assert np.frombuffer(got[7], "<u4").tolist() == whole.tokenizer.encode(texts[7].decode(), add_special_tokens=False).ids


def test_a_word_is_encoded_once_whatever_its_case_and_marks():
    """Forms of a word that differ by case and marks behind it ask the tokenizer once; where that would not give the same ids, they are asked for whole."""
    words, asked = packing.Vocabulary(packing.default_tokenizer(), bound=300), []
    one = words.tokenizer

    class Counting:
        def __init__(self, inner):
            self.inner = inner

        def encode_batch_fast(self, texts, **rest):
            asked.extend(w for t in texts for w in t.split() if w != packing.MARK)
            return self.inner.encode_batch_fast(texts, **rest)

    words.tokenizer = Counting(one)
    if getattr(words, "plainer", None):
        words.plainer = Counting(words.plainer)
    rnd = random.Random(8)
    stems = ["".join(rnd.choices("abcdeéßÿø", k=rnd.randint(3, 9))) for _ in range(150)]
    forms = [f(w) + marks for w in stems for f in (str.lower, lambda w: w[:1].upper() + w[1:]) for marks in ("", ",", "...", "!?", '")')]
    each = lambda text: np.array(one.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    texts = [" ".join(rnd.sample(forms, 60)) for _ in range(400)]
    assert list(words.ids([t.encode() for t in texts])) == list(map(each, texts))
    assert len(asked) < 2 * len(stems) < len(set(" ".join(texts).split())) / 4
    atoms = ["a", "H", "É", "é", "̱", "̸", "ª", "µ", "×", "İ", "Σ", "K", "ſ", "'S", "'ll", "'", "<|endoftext|>", "<|ENDOFTEXT|>", "|", ">", ".", ",", "-", "1", "½", "日", "»", "\u0085", "​", "\x01", " ", "\n"]
    odd = ["".join(rnd.choices(atoms, k=rnd.randint(0, 12))) for _ in range(3000)]
    assert list(words.ids([t.encode() for t in odd])) == list(map(each, odd))
