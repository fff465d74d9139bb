"""License scan: an exact containment join between stretches of text and license templates.

A text block is any stretch of consecutive words no longer than `span` times a template's number of distinct tokens.
A template is found where some block holds at least `threshold` of its distinct tokens. Tokens are ordered by their
document frequency over the whole corpus, rarest first; a block that reaches the threshold must hold one of the template's
first `size - needed + 1` tokens in that order (prefix filter), enough of the tokens after the first one it holds (positional
filter), and at least as many distinct tokens as are needed (length filter). What passes is verified in full.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import common

#: A-Z lower-cased; every byte that is neither 0-9, a-z nor part of a multi-byte character becomes a space.
WORD_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

# Phrases whose places are counted, and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

# Notices as their licenses word them, by label.
TEMPLATES = (
    ("apache", "Licensed under the Apache License, Version 2.0"),
    ("apache", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0. Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."),
    ("mit", "Released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."),
    ("lgpl", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution ShareAlike 4.0 International License"),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0"),
    ("cc0", "To the extent possible under law, the author has dedicated all copyright and related and neighboring rights to this software to the public domain worldwide. This software is distributed without any warranty. CC0 Public Domain Dedication"),
)


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of a whole text; none for a null or empty one."""
    return (text or b"").translate(WORD_TABLE).split()


def places(words: list[bytes], phrases: Iterable[tuple[bytes, str]]) -> list[tuple[int, str]]:
    """Each place (index of its first word) at which the words of a phrase stand consecutively, with the label."""
    line, found = b" " + b" ".join(words) + b" ", []
    for phrase, label in phrases:
        wanted = b" " + phrase + b" "
        at, seen, counted = line.find(wanted), 0, 0
        while at >= 0:
            seen += line.count(b" ", counted, at)
            counted = at
            found.append((seen, label))
            at = line.find(wanted, at + 1)
    return found


class Template:
    """Distinct tokens of one notice, rarest first in the corpus."""

    def __init__(self, label: str, text: str, frequency: dict[bytes, int], threshold: float, span: float):
        self.label = label
        self.order = sorted(set(words_of(text.encode())), key=lambda t: (frequency.get(t, 0), t))
        self.tokens, self.size = frozenset(self.order), len(self.order)
        self.needed = max(1, math.ceil(threshold * self.size - 1e-9))
        self.prefix = frozenset(self.order[: self.size - self.needed + 1])
        self.block = max(self.needed, int(span * self.size))

    def containment(self, words: list[bytes], distinct: set[bytes] | frozenset[bytes]) -> float:
        """The largest share of the template's tokens in any block, 0 where that is below the threshold."""
        first = next((i for i, t in enumerate(self.order[: self.size - self.needed + 1]) if t in distinct), None)
        if first is None or self.size - first < self.needed or len(distinct) < self.needed or len(self.tokens & distinct) < self.needed:
            return 0.0
        hits = [(i, w) for i, w in enumerate(words) if w in self.tokens]
        held: Counter[bytes] = Counter()
        best = low = 0
        for at, word in hits:
            held[word] += 1
            while at - hits[low][0] >= self.block:
                old = hits[low][1]
                held[old] -= 1
                if not held[old]:
                    del held[old]
                low += 1
            best = max(best, len(held))
        return best / self.size if best >= self.needed else 0.0


def token_frequencies(docs: DataFrame, vocabulary: frozenset[bytes], text: str = "text") -> dict[bytes, int]:
    """In how many documents of the whole table each token of `vocabulary` stands.

    The result has at most as many rows as the templates have tokens, whatever the size of the corpus.
    """

    def work(batches):
        counts: Counter[bytes] = Counter()
        for batch in batches:
            for value in common.as_bytes(batch.column(0)):
                counts.update(vocabulary.intersection(words_of(value)))
        yield {"token": [t.decode() for t in counts], "n": list(counts.values())}

    rows = common.map_batches(docs.select(text), work, "token string, n long").groupBy("token").sum("n").collect()
    return {r[0].encode(): r[1] for r in rows}


def scan(docs: DataFrame, threshold: float = 0.9, span: float = 2.0, templates: Iterable[tuple[str, str]] = TEMPLATES, phrases: Iterable[tuple[str, str]] = PHRASES, text: str = "text", key: str = "doc_id") -> DataFrame:
    """One row per document with its phrase places, the labels found and the best containment.

    Null and empty texts have no words, no labels and score 0; repeated rows are scanned once each and stay; ids may be null;
    an empty table gives an empty result. Columns besides `key` and `text` are not read.
    """
    templates, coded = tuple(templates), [(p.encode(), label) for p, label in phrases]
    vocabulary = frozenset(t for _, notice in templates for t in words_of(notice.encode()))
    frequency = token_frequencies(docs, vocabulary, text)
    ordered = [Template(label, notice, frequency, threshold, span) for label, notice in templates]
    prefixes = frozenset().union(*(t.prefix for t in ordered)) if ordered else frozenset()

    def work(batches):
        for batch in batches:
            out = {name: [] for name in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")}
            for doc, value in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), strict=True):
                words = words_of(value)
                base = places(words, coded)
                distinct = vocabulary.intersection(words)
                shares = {t.label: 0.0 for t in ordered}
                if not prefixes.isdisjoint(distinct):
                    for t in ordered:
                        shares[t.label] = max(shares[t.label], t.containment(words, distinct))
                labels = {label for _, label in base}
                starts = [at for at, _ in base]
                found = labels | {label for label, share in shares.items() if share}
                row = (doc, len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels)), ",".join(sorted(found)), max([*shares.values(), 0.0]))
                for name, x in zip(out, row, strict=True):
                    out[name].append(x)
            yield out

    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return common.map_batches(docs.select(key, text), work, schema)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))


QUERIES = {"op1_license_scan": op1_license_scan}
SQL: dict[str, str] = {}
