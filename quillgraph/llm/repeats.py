"""Removal of repeated substrings: every byte covered by a string of `length` bytes that starts anywhere else too. The same run can
tell what strings of a shorter length, `least`, cover.

1. Anchors. In each window of bytes, the k-mer with the smallest hash is the window's anchor, so equal windows share it. Windows in a row
   with one anchor, of both lengths, form a segment. Segments whose anchor occurs once in the corpus hold nothing repeated.
2. Segments with one anchor and equal bytes are a class; all windows of a class of two or more are repeated.
3. What is left to compare are classes with one anchor and different bytes. Of each anchor group, what lies around bytes that several
   segments share goes, in blocks of bounded size, through a Burrows-Wheeler transform: common prefixes are derived by increasing value
   from breadth-first backward extension of intervals, up to `length`; boundaries without a value by then have a common prefix of at
   least `length`. Windows that have the segment's own anchor are counted, so no place is counted twice.
4. Anchor groups over a bound are never brought together: their segments are cut into shorter ranges of windows, keyed by the bytes all
   windows of a range share, and go through step 2 again: first ranges of 46 windows, then single windows, which equality decides.

Only hashes are shuffled in 1, 2 and 4, with map-side aggregation; a hot key's rows can be dealt to several tasks.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillgraph.llm import common

LENGTH, KMER = 400, 32
#: Shorter repeated strings that op10 reports but leaves: passages of over 50 words have some 270 bytes and more.
PASSAGE = 250
#: Largest group of different segments that is compared in one block, bytes of a block, and windows of a range of larger groups.
GROUP, BLOCK, RANGE = 2000, 1 << 20, 46
#: Up to so many texts, the lists of their ranges (under 200 bytes a row) are sent to all tasks instead of shuffling all texts to them.
SENT_TEXTS = 100_000
#: Bytes that are hashed at once; longer texts are hashed in overlapping parts.
PART = 1 << 20
BASE = 0x9E3779B97F4A7C15 | 1
POSITION = np.uint64((1 << 28) - 1)
SEGMENTS = "ah long, sh long, id long, th long, lo int, size int, off int"


class Powers:
    """Powers of the base and of its inverse modulo 2^64."""

    def __init__(self):
        self.n = 0

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > self.n:
            self.n = 1 << max(16, n.bit_length())
            self.up, self.down = (np.multiply.accumulate(np.concatenate([[np.uint64(1)], np.full(self.n, b, np.uint64)]).astype(np.uint64)) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up, self.down


_POWERS = Powers()


class Hashes:
    """Hashes of any substring of some bytes, from one pass."""

    def __init__(self, data: np.ndarray):
        up, self.down = _POWERS.upto(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(0x1D)) * up[: len(data)], out=self.sums[1:])

    def of(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        return common.mix((self.sums[high] - self.sums[low]) * self.down[low] + (high - low).astype(np.uint64))

    def all(self, k: int) -> np.ndarray:
        return common.mix((self.sums[k:] - self.sums[:-k]) * self.down[: len(self.sums) - k] + np.uint64(k))


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each `width` values in a row, from running minima within blocks."""
    n = len(x)
    padded = np.full(-(-n // width) * width, np.iinfo(x.dtype).max, x.dtype)
    padded[:n] = x
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, 1).reshape(-1)
    back = np.minimum.accumulate(blocks[:, ::-1], 1)[:, ::-1].reshape(-1)
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def parts(texts: list[bytes | None], length: int, least: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Joined bytes with, for each stretch of a text of at least `least` bytes: its row, its start in the text, and bounds in the joined bytes
    (one more than stretches). A stretch holds all windows that contain any of its PART places, counted from `length` on but for the first."""
    held, rows, starts, total = [], [], [], 0
    for row, text in enumerate(texts):
        for at in range(0, len(text or b"") if len(text or b"") >= least else 0, PART):
            held.append(text[max(0, at - length) : at + PART + length])
            rows.append(row)
            starts.append(max(0, at - length))
            total += len(held[-1])
            if total >= PART:
                yield np.frombuffer(b"".join(held), np.uint8), np.array(rows), np.array(starts), common.slices(np.array([len(x) for x in held]))
                held, rows, starts, total = [], [], [], 0
    if held:
        yield np.frombuffer(b"".join(held), np.uint8), np.array(rows), np.array(starts), common.slices(np.array([len(x) for x in held]))


def runs_of(key: np.ndarray, valid: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First and last places of runs of valid places with one key; an invalid place lies between equal keys of two runs."""
    first = valid.copy()
    first[1:] &= (key[1:] != key[:-1]) | ~valid[:-1]
    last = valid.copy()
    last[:-1] &= first[1:] | ~valid[1:]
    return np.flatnonzero(first), np.flatnonzero(last)


def segments(keyed: DataFrame, length: int, k: int, least: int) -> DataFrame:
    """Rows SEGMENTS for texts keyed by (id, th): anchor hash, hash of the bytes, start, number of bytes, offset of the anchor."""

    def work(batches):
        for batch in batches:
            ids, hashes = (np.asarray(batch.column(c).to_numpy(zero_copy_only=False)) for c in (0, 1))
            for data, rows, starts, bounds in parts(common.as_bytes(batch.column(2)), length, least):
                h = Hashes(data)
                kmers = h.all(k)
                placed = (kmers & ~POSITION) | np.arange(len(kmers), dtype=np.uint64)
                stretch = np.repeat(np.arange(len(rows)), np.diff(bounds))
                found, lowest = [], sliding_min(placed, least - k + 1)
                for size in sorted({length, least}):
                    if len(data) < size:
                        continue
                    if size > least:
                        lowest = np.minimum(lowest[: least - size], lowest[size - least :]) if size - k + 1 <= 2 * (least - k + 1) else sliding_min(placed, size - k + 1)
                    anchor = (lowest & POSITION).astype(np.int64)
                    low, high = runs_of(anchor, np.arange(len(anchor)) + size <= bounds[1:][stretch[: len(anchor)]])
                    found.append((anchor[low], low, high + size))
                # a place that is the anchor of long windows is the anchor of short ones inside them, which the long ones cover
                p, low, high = found[0]
                for longer, a, b in found[1:]:
                    at = np.searchsorted(p, longer)
                    low[at], high[at] = a, b
                place = p - bounds[stretch[p]] + starts[stretch[p]]
                own = (place // PART * PART - length).clip(0) == starts[stretch[p]]
                p, low, high = p[own], low[own], high[own]
                off = p - low
                sh = common.mix(h.of(low, high) ^ common.mix(off.astype(np.uint64)))
                at = rows[stretch[p]]
                yield {"ah": kmers[p].view(np.int64), "sh": sh.view(np.int64), "id": ids[at], "th": hashes[at], "lo": (low - bounds[stretch[p]] + starts[stretch[p]]).astype(np.int32), "size": (high - low).astype(np.int32), "off": off.astype(np.int32)}

    return common.map_batches(keyed, work, SEGMENTS)


def own_windows(size, off, length: int, k: int):
    """First and last windows of `length` bytes, from the start of a segment of so many bytes, that have its anchor (last < first: none).

    A segment reaches as far as its anchor does, so any window in it that holds the anchor and starts no later has it."""
    return np.maximum(off - (length - k), 0), np.minimum(off, size - length)


def refine(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Split SEGMENTS rows (and more columns, equal in a class) into those known to be repeated (id, th, lo, size, more) and representatives
    still to be compared.

    Representatives (SEGMENTS, more and k, the number of classes of their anchor) are one of each class, whichever comes first, of anchors
    with at least two classes of which one has a single member. Rows of hot classes and anchors are never brought together.
    """
    more = rows.columns[7:]
    rows = common.cut(rows)
    classes = common.cut(rows.groupBy("ah", "sh").agg(F.count("*").alias("members"), *[F.first(c).alias(c) for c in ("id", "th", "lo", "size", "off", *more)]))
    several = classes.where("members > 1").select("ah", "sh", "members")
    known = common.join_weighted(rows, several, ["ah", "sh"], "members", common.rows_of(rows)).select("id", "th", "lo", "size", *more)
    groups = common.cut(classes.groupBy("ah").agg(F.count("*").alias("k"), F.min("members").alias("least")).where("k > 1 and least = 1"))
    return known, common.join_weighted(classes, groups, ["ah"], "k", common.rows_of(classes)).select("ah", "sh", "id", "th", "lo", "size", "off", *more, "k")


def listed(rows: DataFrame, *columns: str) -> DataFrame:
    """One row per text with its list of ranges, at most a few for each window of the text."""
    return rows.groupBy("id", "th").agg(F.collect_list(F.struct(*columns)).alias("list"))


def with_bytes(keyed: DataFrame, reps: DataFrame, few: bool = False) -> DataFrame:
    """(id, th, text, list) of texts that have representatives; of repeated rows with equal keys, one is enough."""
    lists = listed(reps, "ah", "lo", "size", "off", "only")
    if few:
        lists = common.cut(lists)
        texts, ranges = lists.agg(F.count("*"), F.sum(F.size("list"))).first()
        few = texts <= SENT_TEXTS and (ranges or 0) <= 5 * SENT_TEXTS
    return keyed.join(F.broadcast(lists) if few else lists.hint("shuffle_hash"), ["id", "th"]).select("id", "th", "text", "list")


def shorter(lists: DataFrame, windows: int, lengths: list[int], k: int) -> DataFrame:
    """Cut segments into ranges of `windows` windows of one length, counted from the anchor: rows SEGMENTS keyed by the bytes
    that all windows of a whole range share (a segment may hold only some of them), and that length as `only`."""

    def work(batches):
        for batch in batches:
            for key, th, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                h = Hashes(np.frombuffer(text, np.uint8))
                for length in lengths:
                    given = {(r["ah"], r["lo"], r["size"], r["off"]) for r in ranges if r["only"] in (0, length)}
                    if given:
                        yield from cut(key, th, h, given, length, min(windows, length - k + 1))

    def cut(key, th, h, given, length, windows):
        ah, lo, size, off = (np.array(x, np.int64) for x in zip(*sorted(given), strict=True))
        first, last = own_windows(size, off, length, k)
        n = np.maximum(last - first + 1, 0)
        start = common.ranges(lo + first, n)
        if not len(start):
            return
        p, of, ah = np.repeat(lo + off, n), np.repeat(np.arange(len(lo)), n), np.repeat(ah, n)
        place = (p - start) // windows
        new = np.concatenate([[True], (place[1:] != place[:-1]) | (of[1:] != of[:-1])])
        low = np.flatnonzero(new)
        high = np.concatenate([low[1:], [len(start)]]) - 1
        a, b, p, place = start[low], start[high], p[low], place[low]
        tag = common.mix(ah[low].view(np.uint64) + common.mix(place.astype(np.uint64) + np.uint64(length << 32)))
        core = common.mix(h.of(p - place * windows, p - (place + 1) * windows + 1 + length) ^ tag)
        hull = common.mix(h.of(a, b + length) ^ common.mix((p - a).astype(np.uint64)))
        yield {"ah": core.view(np.int64), "sh": hull.view(np.int64), "id": np.full(len(a), key), "th": np.full(len(a), th), "lo": a.astype(np.int32), "size": (b - a + length).astype(np.int32), "off": (p - a).astype(np.int32), "only": np.full(len(a), length, np.int32)}

    return common.map_batches(lists, work, SEGMENTS + ", only int")


def depth_sorted(t: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Suffixes of t (values up to 256) in the order of their first `depth` symbols at least, by prefix doubling on what is still tied;
    with it the keys of seven symbols at each position and the rank of each suffix."""
    n = len(t)
    keys = np.zeros(n + 7, np.int64)
    keys[:n] = t
    keys = sum(keys[j : j + n] << (9 * (6 - j)) for j in range(7))
    order = np.argsort(keys)
    ordered = keys[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    rank = np.zeros(n + depth + 8, np.int64)
    group = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank[order] = group + 1
    tied = ~(new & np.concatenate([new[1:], [True]]))
    h = 7
    while h < depth and tied.any():
        slots = np.flatnonzero(tied)
        at = order[slots]
        key = rank[at] * (n + 2) + rank[np.minimum(at + h, n)]
        by = np.argsort(key)
        key, at = key[by], at[by]
        order[slots] = at
        new = np.concatenate([[True], key[1:] != key[:-1]])
        rank[at] = slots[np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))] + 1
        tied[slots] = ~(new & np.concatenate([new[1:], [True]]))
        h *= 2
    return order, keys, rank[:n] - 1


def common_prefixes(t: np.ndarray, length: int, warm: int = 28) -> tuple[np.ndarray, np.ndarray]:
    """Common prefix of neighbouring suffixes of t (0 ends a piece), where it is below `length`, else -1; and the sorted suffixes.

    Values below `warm` are read off the sort keys. From there, all intervals whose right boundary has the value l - 1 are extended
    to the left by every symbol that precedes them; an extension whose right boundary has no value yet gets l and is extended next.
    """
    order, keys, _ = depth_sorted(t, length)
    n = len(t)
    prefix = np.full(n + 1, -1, np.int32)
    prefix[0] = prefix[n] = 0
    warm = min(warm, length) // 7 * 7
    open_at = np.arange(1, n)
    padded = np.concatenate([keys, np.zeros(warm + 1, np.int64)])
    for at in range(0, warm, 7):
        ahead = padded[order + at]
        differ = ahead[open_at - 1] ^ ahead[open_at]
        found = differ > 0
        differ = differ[found]
        # the highest bit that differs; without its lower neighbours, so the float is not rounded up to the next one
        prefix[open_at[found]] = at + 7 - (np.frexp((differ & ~(differ >> 1)).astype(np.float64))[1] + 8) // 9
        open_at = open_at[~found]
    bwt = t.astype(np.uint16)[order - 1]
    bwt[order == 0] = 0
    last_first = np.empty(n, np.int32)
    last_first[np.argsort(bwt, kind="stable")] = np.arange(n, dtype=np.int32)
    level = max(warm, 1)
    starts = np.flatnonzero((prefix[:n] >= 0) & (prefix[:n] < level))
    ends = np.concatenate([starts[1:], [n]])
    newest = (prefix[ends] == level - 1) & (ends < n) if warm else np.ones(len(starts), bool)
    low, high = starts[newest], ends[newest] - 1
    while level < length and len(low):
        sizes = high - low + 1
        rows = common.ranges(low, sizes)
        of = np.repeat(np.arange(len(low)), sizes)
        c = bwt[rows]
        kept = c > 0
        place, c, of = last_first[rows[kept]], c[kept], of[kept]
        by = np.argsort(place)
        place, c, of = place[by], c[by], of[by]
        if not len(place):
            break
        new = np.concatenate([[True], (c[1:] != c[:-1]) | (of[1:] != of[:-1])])
        first = np.flatnonzero(new)
        low, high = place[first], place[np.concatenate([first[1:], [len(place)]]) - 1]
        fresh = prefix[high + 1] < 0
        low, high = low[fresh], high[fresh]
        prefix[high + 1] = level
        level += 1
    return prefix, order


def repeated_windows(pieces: list[bytes], length: int) -> list[np.ndarray]:
    """For each piece, which of its windows (by start) are found twice or more in all pieces."""
    return repeated_own(pieces, [length], [(np.zeros(len(pieces), np.int64), np.array([len(p) - length for p in pieces]))])[0]


def repeated_own(pieces: list[bytes], lengths: list[int], own: list[tuple[np.ndarray, np.ndarray]]) -> list[list[np.ndarray]]:
    """For each length and piece, which of its windows (by start) are found twice or more among the windows that count: those from a first
    to a last one of each piece, given for each length."""
    t = np.zeros(sum(map(len, pieces)) + len(pieces), np.int64)
    bounds = common.slices(np.array([len(p) + 1 for p in pieces]))
    for p, at in zip(pieces, bounds, strict=False):
        t[at : at + len(p)] = np.frombuffer(p, np.uint8)
        t[at : at + len(p)] += 1
    prefix, order = common_prefixes(t, max(lengths))
    out = []
    for length, (first, last) in zip(lengths, own, strict=True):
        counted = np.zeros(len(t), bool)
        counted[common.ranges(bounds[:-1] + first, np.maximum(last - first + 1, 0))] = True
        equal = np.cumsum((prefix[:-1] >= 0) & (prefix[:-1] < length))
        some = np.flatnonzero(counted[order])
        again = np.zeros(len(t), bool)
        again[order[some]] = np.bincount(equal[some], minlength=equal[-1] + 1 if len(equal) else 0)[equal[some]] > 1
        out.append([again[at : at + max(0, len(p) - length + 1)] for p, at in zip(pieces, bounds, strict=False)])
    return out


def contenders(group: dict, length: int, k: int) -> Iterator[tuple]:
    """Of the segments of an anchor, by (id, th, lo), the stretches in which a window of `length` bytes with that anchor can be found in another
    one as well: (id, th, lo, offset of the anchor, bytes).

    Windows are taken in ranges counted from the anchor, as in `shorter`; the bytes that all windows of a range share must be in two
    segments. Longer windows hold such a window, so they cannot reach beyond the stretch, unless its anchor's windows do not either."""
    windows = min(RANGE, length - k + 1)
    cores, seen = {}, {}
    for place, (off, data) in group.items():
        first, last = own_windows(len(data), off, length, k)
        for r in range((off - last) // windows, (off - first) // windows + 1) if first <= last else ():
            core = r, data[off - r * windows : off - (r + 1) * windows + 1 + length]
            cores.setdefault(place, []).append(core)
            seen[core] = seen.get(core, 0) + 1
    for place, held in cores.items():
        found = [r for r, core in held if seen[r, core] > 1]
        if found:
            off, data = group[place]
            first, last = own_windows(len(data), off, length, k)
            first, last = max(first, off - (found[-1] + 1) * windows + 1), min(last, off - found[0] * windows)
            low = first if first > off - (length - k) else 0
            high = last + length if last < off else len(data)
            key, th, lo = place
            yield key, th, lo + low, off - low, data[low:high]


def compare(lists: DataFrame, length: int, least: int, k: int, block: int) -> DataFrame:
    """Bytes (id, th, lo, size, only) that repeated windows of representatives cover, repeated within their anchor's group; groups are within
    the bound. With 0 as `only`, windows of both lengths are sought."""

    def cut_out(batches):
        for batch in batches:
            for key, th, text, ranges in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), common.as_bytes(batch.column(2)), batch.column(3).to_pylist(), strict=True):
                given = sorted({(r["ah"], r["lo"], r["size"], r["off"], r["only"]) for r in ranges})
                ah, lo, _, off, only = zip(*given, strict=True)
                yield {"ah": ah, "id": [key] * len(given), "th": [th] * len(given), "lo": lo, "off": off, "only": only, "bytes": [text[x : x + size] for _, x, size, _, _ in given]}

    def blocks(batches):
        held, size, group, last, sought = [], 0, {}, None, 0
        for batch in batches:
            for ah, key, th, lo, off, only, data in zip(*(batch.column(c).to_pylist() for c in range(7)), strict=True):
                if ah != last:
                    fresh = [(sought, *x) for x in contenders(group, sought or least, k)]
                    held += fresh
                    size += sum(len(x[-1]) for x in fresh)
                    group, last, sought = {}, ah, only
                    if size >= block:
                        yield from solve(held)
                        held, size = [], 0
                group[key, th, lo] = off, data
        yield from solve(held + [(sought, *x) for x in contenders(group, sought or least, k)])

    def solve(held):
        if not held:
            return
        out = {"id": [], "th": [], "lo": [], "size": [], "only": []}
        only, off, sizes = np.array([(only, off, len(data)) for only, _, _, _, off, data in held]).T
        lengths = sorted({length, least})
        own = []
        for n in lengths:
            first, last = own_windows(sizes, off, n, k)
            own.append((first, np.where((only == 0) | (only == n), last, first - 1)))
        for n, flags in zip(lengths, repeated_own([x[-1] for x in held], lengths, own), strict=True):
            for (_, key, th, lo, _, _), again in zip(held, flags, strict=True):
                edges = np.flatnonzero(np.diff(np.concatenate([[0], again.view(np.int8), [0]])))
                for a, b in edges.reshape(-1, 2).tolist():
                    for name, value in zip(out, (key, th, lo + a, b - a + n - 1, n), strict=True):
                        out[name].append(value)
        yield out

    pieces = common.map_batches(lists, cut_out, "ah long, id long, th long, lo int, off int, only int, bytes binary")
    return common.map_batches(pieces.repartition("ah").sortWithinPartitions("ah"), blocks, "id long, th long, lo int, size int, only int")


def keyed_texts(docs: DataFrame, text: str, key: str) -> DataFrame:
    """(id, th, text): rows with equal keys have equal ids and, but for a hash collision within one id, equal texts."""
    return docs.select(ident(key).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"), F.col(text).alias("text"))


NO_ID = -(1 << 63)


def ident(key: str):
    """The id, with the smallest long for null."""
    return F.coalesce(F.col(key).cast("long"), F.lit(NO_ID))


def repeated(docs: DataFrame, length: int = LENGTH, k: int = KMER, group: int = GROUP, block: int = BLOCK, text: str = "text", key: str = "doc_id", least: int | None = None) -> DataFrame:
    """(id, th, list of <lo, size, only>): what repeated windows cover in every text that has some. Windows are of `length` bytes; those of `least`
    bytes, if it is given, are listed too, with `least` as `only` where no window of `length` bytes need be repeated."""
    least = least or length
    keyed = keyed_texts(docs, text, key)
    known, reps = (x.withColumn("only", F.lit(0)) for x in refine(segments(keyed, length, k, least)))
    reps = common.cut(reps)
    found, small = [known], reps.where(F.col("k") <= group)
    for windows in (RANGE, 1):
        large = reps.where(F.col("k") > group)
        if large.isEmpty():
            break
        known, reps = refine(shorter(with_bytes(keyed, large, few=True), windows, sorted({length, least}), k))
        found.append(known)
        reps = common.cut(reps)
        small = small.unionByName(reps.where(F.col("k") <= group))
    found.append(compare(with_bytes(keyed, small), length, least, k, block))
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    whole = (F.col("size") >= length) & F.col("only").isin(0, length)
    return listed(every.withColumn("only", F.when(whole, length).otherwise(least)), "lo", "size", "only")


def spans(ranges: list[dict], length: int = 0) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by windows of at least so many bytes."""
    out: list[list[int]] = []
    for low, high in sorted((r["lo"], r["lo"] + r["size"]) for r in ranges or () if r["only"] >= length):
        if out and low <= out[-1][1]:
            out[-1][1] = max(out[-1][1], high)
        else:
            out.append([low, high])
    return [(a, b) for a, b in out]


def without(text: bytes, removed: list[tuple[int, int]]) -> bytes:
    ends = [0, *(x for span in removed for x in span), len(text)]
    return b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True))


def digest(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", least: int | None = None, **bounds) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256; with `least`, also n_repeated: bytes covered by strings of
    `least` bytes that start elsewhere too, removed or not.

    Null and empty texts have no bytes. Strings are judged on the input, and rows that are repeated count as places, so all long texts
    among equal ones are removed whole. Null ids stay null; an empty table gives an empty result; no other column is read.
    """
    ranges = repeated(docs, length, text=text, key=key, least=least, **bounds)
    rows = keyed_texts(docs, text, key)  # the same rows that the comparison shuffles, so Spark reuses that exchange
    joined = rows.join(ranges.hint("shuffle_hash"), ["id", "th"], "left").select(F.when(F.col("id") != NO_ID, F.col("id")).alias("doc_id"), "text", "list")

    def work(batches):
        for batch in batches:
            out = {name: [] for name in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["n_repeated"] * bool(least))}
            for doc, value, ranges in zip(batch.column(0).to_pylist(), common.as_bytes(batch.column(1)), batch.column(2).to_pylist(), strict=True):
                value, removed = value or b"", spans(ranges, length)
                row = (doc, len(value), sum(b - a for a, b in removed), len(removed), hashlib.sha256(without(value, removed)).hexdigest(), sum(b - a for a, b in spans(ranges)))
                for name, x in zip(out, row, strict=False):
                    out[name].append(x)
            yield out

    return common.map_batches(joined, work, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", n_repeated long" * bool(least))


def remove(docs: DataFrame, length: int = LENGTH, text: str = "text", key: str = "doc_id", **bounds) -> DataFrame:
    """`docs` with the repeated bytes cut out of `text`; characters that are cut through go whole. Other columns stay as they are;
    a text of which nothing is left becomes empty, a null text stays null."""
    i, h, found = (common.private(docs, c) for c in ("__id", "__th", "__list"))
    ranges = repeated(docs, length, text=text, key=key, **bounds).select("id", "th", "list").toDF(i, h, found)
    joined = docs.join(ranges.hint("shuffle_hash"), (ident(key) == F.col(i)) & (F.xxhash64(F.coalesce(F.col(text), F.lit(""))) == F.col(h)), "left").drop(i, h)
    place = docs.columns.index(text)

    def work(batches):
        for batch in batches:
            values, lists = common.as_bytes(batch.column(place)), batch.column(len(docs_columns)).to_pylist()
            kept = [v if v is None or not r else without(v, spans(r, length)).decode("utf-8", "ignore").encode() for v, r in zip(values, lists, strict=True)]
            columns = [batch.column(c) for c in range(len(docs_columns))]
            columns[place] = pa.array(kept, pa.binary()).cast(pa.string()).cast(columns[place].type)
            yield pa.RecordBatch.from_arrays(columns, names=docs_columns)

    docs_columns = docs.columns
    return joined.mapInArrow(common.releasing(work), docs.schema)


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.table(spark, sf_dir, "documents"), least=PASSAGE)


QUERIES = {"op10_suffix_array_dedup": op10_suffix_array_dedup}
SQL: dict[str, str] = {}
