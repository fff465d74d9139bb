"""Main text of HTML pages by the distribution of text over blocks of lines.

Markup is stripped to lines, one for each block element; boilerplate elements leave gaps of empty lines. What only a class, an id or a
form marks as boilerplate is none if it wraps the page: if the one marked article is in it, or else most of the unlinked text. The text length of each
window of lines is summed. Text surges where a window's sum becomes positive and dives where it falls to zero; each stretch between a surge
and its dive is a candidate. The stretch with the most text is the start, and from there on, whatever its length, each one is text that is
near an accepted one: a few lines away, or in the same element or one beside it. Lines that are mostly links count as empty if their
element's text is mostly links too. Marks only weigh lines: text in a marked article counts tenfold, so its stretches are the text unless
another stretch holds over ten times as much, as where only teasers are marked.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from quillgraph.llm import common

#: Lines of a window; a gap is as long, so stretches on its sides never share a window.
WINDOW = 3
#: Of an unmarked page: most empty lines between near stretches (a gap, or a few lines of links), and most share of link text.
NEAR, LINKS = 2 * WINDOW, 0.6
#: Weight of text outside the marked articles of a page that has some.
OUTSIDE = 0.1

# Fixed values of the HTML standard: elements by their role.
BLOCKS = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre section summary table tbody td tfoot th thead tr ul".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = ("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes", "noscript", "template", "svg", "math", "object", "canvas", "audio", "video")
HOLDERS = frozenset("body div section article main td center".split())
BOILERPLATE = frozenset("nav header footer aside form menu dialog button select head fieldset label".split())
#: Boilerplate elements that may wrap a whole page.
WRAPPERS = frozenset("form fieldset".split())
#: Closed by the start of another of the same kind.
SELF_CLOSING = {"p": "p", "li": "li", "dt": "dt dd", "dd": "dt dd", "tr": "tr td th", "td": "td th", "th": "td th", "option": "option"}

#: Words of class, id and role attributes that mark boilerplate, and those of them for text by readers, which may be most of a page.
BAD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|adsense|sponsor\w*|promo\w*|banner|cookie\w*|consent|gdpr|notice\w*|alert|popup|modal|overlay|newsletter|subscribe|signup|login|sidebar\w*|side|aside|widget\w*|menu\w*|nav\w*|breadcrumbs?|pagination|pager|header|masthead|topbar|toolbar|footer|copyright|legal|social|share|sharing|related|recommend\w*|comments?|commentlist|disqus|replies|reply|respond|search|form|tags?|hidden)(?=$|[\s_-])", re.I)
READERS = re.compile(r"(?:^|[\s_-])(?:comments?|commentlist|disqus|replies|reply|respond)(?=$|[\s_-])", re.I)
ROLES = frozenset("navigation banner contentinfo complementary search form alert dialog menu".split())

TOKEN = re.compile(r"<!--.*?(?:-->|$)|<![^>]*>|<\?[^>]*>|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>|<(?P<close2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<rest2>[^>]*)>", re.S)
ATTRIBUTE = re.compile(r"""\b(class|id|role|aria-hidden|style|itemprop)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
HIDDEN = re.compile(r"\bhidden\b(?!\s*=)", re.I)
ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in RAW}


def role_of(name: str, rest: str) -> int:
    """1 for a marked article, 0 for nothing; below 0 for boilerplate: -1 if it may wrap the page, -2 if only around a marked article, -3 if never."""
    if name in ("article", "main"):
        return 1
    if name in BOILERPLATE and name not in WRAPPERS:
        return -3
    if not rest or name in ("body", "html"):
        return -(name in WRAPPERS)
    words = []
    for key, a, b, c in ATTRIBUTE.findall(rest):
        key, value = key.lower(), a or b or c
        if key == "role" and value.lower() in ROLES or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return -3
        if key == "role" and value.lower() in ("main", "article") or key == "itemprop" and value == "articleBody":
            return 1
        if key in ("class", "id"):
            words.append(value)
    marks = " ".join(words)
    if HIDDEN.search(ATTRIBUTE.sub("", rest)):
        return -3
    if marks and BAD.search(marks):
        return -2 if READERS.search(marks) else -1
    return -(name in WRAPPERS)


class Page:
    """Lines of a page: text, whether inside a marked article, length of link text, and number of the enclosing element.

    Lines in boilerplate are kept aside until the end shows which of its elements wrap the page.
    """

    def __init__(self, source: str):
        self.lines: list[tuple[str, bool, int, int]] = []
        self.piece: list[str] = []
        self.linked = 0
        self.open: list[tuple[str, int, int]] = []
        self.names: Counter[str] = Counter()  # of the open elements
        self.holders, self.around = [0], {0: 0}  # numbers of the open elements that hold lines, and of the one around each
        self.opened = 0
        self.good = 0
        self.bad: list[int] = [0]  # places in `kinds` of the open boilerplate elements
        self.kinds: list[tuple[int, int]] = [(0, 0)]  # role and place of the one around, for each boilerplate element
        self.within: list[int] = []  # for each line, the innermost of them, or 0
        at, end = 0, len(source)
        while at < end:
            tag = TOKEN.search(source, at)
            self.text(source[at : tag.start() if tag else end])
            if not tag:
                break
            at = tag.end()
            name = (tag["name"] or tag["name2"] or "").lower()
            if not name:
                continue
            rest = tag["rest"] if tag["name"] else tag["rest2"]
            if tag["close"] or tag["close2"]:
                self.close(name)
            elif name in ENDS and not rest.endswith("/"):
                stop = ENDS[name].search(source, at)
                at = stop.end() if stop else end if name in ("script", "style") else at
            else:
                self.start(name, rest)
        self.line()
        self.settle()

    def settle(self) -> None:
        """Lines in boilerplate become gaps, but for those of the elements that wrap the page."""
        kept = {0} | self.wrapping()
        lines, self.lines = self.lines, []
        for line, place in zip(lines, self.within, strict=True):
            if place in kept and line[3] >= 0:
                self.lines.append(line)
            elif not self.lines or self.lines[-1][3] >= 0:  # any number of dropped elements in a row is one gap
                self.lines += [("", False, 0, -1)] * WINDOW

    def wrapping(self) -> set[int]:
        """The boilerplate element that wraps the page, if there is one, and those around it."""
        least = [0] * len(self.kinds)  # of the roles from the outermost element in
        for place, (role, around) in enumerate(self.kinds[1:], 1):
            least[place] = min(role, least[around])
        marked, plain = [0] * len(least), [0] * len(least)
        for (words, good, linked, _), place in zip(self.lines, self.within, strict=True):
            marked[place] += len(words) * good
            plain[place] += len(words) - linked
        if marked[0]:
            return set()
        place = max((k for k in range(len(least)) if least[k] > -3), key=lambda k: marked[k])
        if not marked[place]:
            place = max((k for k in range(len(least)) if least[k] > -2), key=lambda k: plain[k])
            held = plain.copy()
            for k in range(len(held) - 1, 0, -1):
                held[self.kinds[k][1]] += held[k]
            if 2 * held[place] <= held[0]:
                return set()
        found = set()
        while place:
            found.add(place)
            place = self.kinds[place][1]
        return found

    def text(self, raw: str) -> None:
        if raw:
            self.piece.append(raw)
            if self.names["a"]:
                self.linked += len(raw)

    def line(self) -> None:
        if self.piece:
            words = " ".join(html.unescape("".join(self.piece)).split())
            self.lines.append((words, self.good > 0, min(self.linked, len(words)), self.holders[-1]))
            self.within.append(self.bad[-1])
            self.piece, self.linked = [], 0

    def gap(self) -> None:
        self.line()
        self.lines.append(("", False, 0, -1))
        self.within.append(0)

    def start(self, name: str, rest: str) -> None:
        if name == "br" or name == "wbr":
            self.piece += [" "] * (name == "br")
            return
        if name in BLOCKS:
            self.line()
        if name in VOID:
            return
        if name in SELF_CLOSING and self.open and self.open[-1][0] in SELF_CLOSING[name].split():
            self.close(self.open[-1][0])
        elif name in BLOCKS and any(n == "p" for n, _, _ in self.open[-4:]):
            self.close("p")
        role = role_of(name, rest)
        if role:
            self.gap()
        if role < 0:
            self.kinds.append((role, self.bad[-1]))
            self.bad.append(len(self.kinds) - 1)
        self.good += role > 0
        self.opened += 1
        self.open.append((name, role, self.opened))
        self.names[name] += 1
        if name in HOLDERS:
            self.around[self.opened] = self.holders[-1]
            self.holders.append(self.opened)

    def close(self, name: str) -> None:
        if name in BLOCKS:
            self.line()
        if not self.names[name]:
            return
        while self.open:
            last, role, _ = self.open.pop()
            self.names[last] -= 1
            if last in HOLDERS:
                self.holders.pop()
            if role:
                self.gap()
            if role < 0:
                self.bad.pop()
            self.good -= role > 0
            if last == name:
                break


def stretches(lengths: np.ndarray, window: int = WINDOW) -> list[tuple[int, int]]:
    """Line ranges between a surge (a window's sum becomes positive) and its dive (it falls to zero)."""
    sums = np.convolve(lengths, np.ones(window, int))[: len(lengths)]  # of the lines up to each one
    positive = np.concatenate([[False], sums > 0, [False]])
    edges = np.flatnonzero(positive[1:] != positive[:-1]).reshape(-1, 2)
    return [(int(a), int(b)) for a, b in edges]


def near_longest(found: list[tuple[int, int]], lengths: np.ndarray, held: list[int], around: dict[int, int], near: int = NEAR) -> list[tuple[int, int]]:
    """The stretch with the most text and, to both sides, those near an accepted one; `held` has each line's element."""
    used = [[i for i in range(a, b) if lengths[i]] for a, b in found]
    start = max(range(len(found)), key=lambda k: int(lengths[used[k]].sum()))
    accepted, places = {start}, set()

    def accept(k: int) -> None:
        accepted.add(k)
        places.update(x for i in used[k] for x in (held[i], around[held[i]]))

    accept(start)
    for step, end in ((-1, -1), (1, len(found))):
        for k in range(start + step, end, step):
            gap = used[k + 1][0] - used[k][-1] - 1 if step < 0 else used[k][0] - used[k - 1][-1] - 1
            if k - step in accepted and gap <= near or any(x in places for i in used[k] for x in (held[i], around[held[i]])):
                accept(k)
    return [found[k] for k in sorted(accepted)]


def main_text(source: str | None, window: int = WINDOW, links: float = LINKS, outside: float = OUTSIDE) -> str:
    """Main text of a page: its blocks in order, joined by line feeds; empty for a null or empty page, or if there is none."""
    if not source:
        return ""
    page = Page(source)
    lines = page.lines
    if not lines:
        return ""
    total, linked_in = Counter(), Counter()
    for words, _, linked, holder in lines:
        total[holder] += len(words)
        linked_in[holder] += linked
    lengths = np.array([len(words) * (linked <= links * len(words) or linked_in[holder] <= links * total[holder]) for words, _, linked, holder in lines])
    marked = np.array([len(words) * good for words, good, _, _ in lines])
    others = np.where(marked > 0, 0, lengths)
    best = max((int(others[a:b].sum()) for a, b in stretches(others, window)), default=0)
    if marked.any() and marked.sum() >= outside * best:
        lengths, found = marked, stretches(marked, window)
    elif found := stretches(lengths, window):
        found = near_longest(found, lengths, [x[3] for x in lines], page.around)
    return "\n".join(lines[i][0] for a, b in found for i in range(a, b) if lengths[i])


def extract(pages: DataFrame, key: str = "page_id", url: str = "url", source: str = "html") -> DataFrame:
    """One row per page: page_id, url, text, n_chars.

    A null or empty page has an empty text. Ids and addresses may be null, repeated rows stay, an empty table gives an empty
    result, and no other column is read. Pages of any length are parsed whole, in time proportional to their length.
    """

    def work(batches):
        for batch in batches:
            texts = [main_text(x) for x in batch.column(2).to_pylist()]
            yield {"page_id": batch.column(0).cast("int64"), "url": batch.column(1), "text": texts, "n_chars": [len(t) for t in texts]}

    return common.map_batches(pages.select(key, url, source), work, "page_id long, url string, text string, n_chars long")


def op6_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(common.table(spark, sf_dir, "pages"))


QUERIES = {"op6_html_extraction": op6_html_extraction}
SQL: dict[str, str] = {}
