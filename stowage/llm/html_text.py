"""Main text of HTML pages: flat text blocks, classified by a decision tree.

The page is cut into blocks of text at block-level tags. A block's features
are its number of words and link density, those of the block before and after
it, the place that holds it (:data:`PLACES`: what the innermost telling element
around it says), the share of the page's words in blocks of that place, and the
share in articles and main parts. A decision tree (Gini, axis-parallel splits)
that is trained here on a small table of labelled pages says which blocks are
content. No place decides alone: link lists in a main part are no content, and
text in wrappers whose names hint at adverts or menus is, if it is long and the
page has no better place. Scripts, styles, comments and the head are no text.

Character references are decoded, white space within a block becomes one
space, blocks are joined in page order by one space.

Markup is read in one pass whose time is linear in the page, however it is
broken: a quote counts only after ``=``, and none does after a tag in which one
never ends; an end tag that is missing once is not looked for again.

Defined results: a null or empty page, or one without content blocks, has the
empty text. Markup that is cut short or nested wrongly is read as far as it
goes; an unclosed comment, tag, script, style, title or textarea reaches to the
end, other elements without text that are not closed are ignored. Rows are
independent; all columns but ``text`` and ``n_chars`` are kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import cache
from html import unescape

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .memory import give_back, small_batches
from .shared import free_name

#: HTML's elements by what they do to text.
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol optgroup option p pre search section select summary table tbody td template textarea tfoot th thead title tr ul button".split())
TO_END = frozenset("script style textarea title".split())
NO_TEXT = TO_END | frozenset("xmp iframe noembed noframes svg math canvas object audio video select template noscript".split())
NESTED = frozenset("article aside button details dialog div dl fieldset figure footer form header label main menu nav ol section table td ul".split())
AROUND = frozenset("aside button dialog fieldset footer label menu nav".split())
#: Words of class, id and role.
HINTS = frozenset("ad ads adbox advert adverts advertisement advertising banner breadcrumb breadcrumbs byline captcha consent cookie cookies copyright dialog footer form gdpr header login menu menubar modal nav navbar navigation newsletter notice notification pager pagination popup promo promotion related search share sharing sidebar signin signup skip social sponsor sponsored subscribe subscription tags toc toolbar widget contentinfo complementary alert".split())
READERS = frozenset("comment comments commentlist disqus reply replies respond".split())
HOME = frozenset("article content entry main post story articlebody maincontent".split())
#: Words that make a name say that something is beside, or missing.
BESIDE = frozenset("has have with without no not is hide".split())
#: Places of a block, by the innermost element that tells: 2 an article, 1 a main
#: part, 0 none, -1 a form or a name that hints at other things, -2 an element
#: for menus and the like, -3 comments of readers.
PLACES = ARTICLE, MAIN, NONE, HINT, BESIDES, COMMENTS = 2, 1, 0, -1, -2, -3

_NEXT = re.compile(r"<(?:(!--)|[!?]|/?[a-zA-Z]|/)")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>=]++|=\s*+(?:"[^"]*+"|'[^']*+'|))*+)>""")
_PLAIN_TAG = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_NAMED = re.compile(r"""(?:^|\s)(?:class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.I)
_WORD = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"([a-z])([A-Z])")


def _named(attributes: str) -> int | None:
    """The place that the names in class, id and role tell, if any."""
    told: set[int] = set()
    for found in _NAMED.findall(attributes):
        for name in "".join(found).split():
            words = _WORD.findall(_CAMEL.sub(r"\1 \2", name).lower())
            # "has-sidebar" and "page-with-menu" are no sidebar and no menu; "entry-header" is a heading
            words = words[: next((i for i, w in enumerate(words) if w in BESIDE), len(words))]
            hints = HINTS.intersection(words) - ({"header"} if HOME.intersection(words) else set())
            if READERS.intersection(words):
                told.add(COMMENTS)
            elif hints and "body" not in words:
                told.add(HINT)
            elif HOME.intersection(words) and "header" not in words:
                told.add(MAIN)
    return min(told, default=None)


def _place(name: str, attributes: str, inside: int) -> int:
    """The place within an element in the place ``inside``."""
    if name == "main":
        return MAIN
    told = _named(attributes) if attributes else None
    if COMMENTS in (inside, told):
        return COMMENTS
    if name in AROUND or inside == BESIDES:
        return BESIDES
    if name == "article":
        return ARTICLE
    if told == HINT or name == "form" or name == "header" and inside < MAIN:
        return HINT
    return max(inside, MAIN) if told == MAIN else inside


def tags(html: str) -> Iterator[tuple[int, int, str, str, str]]:
    """(start, end, ``/`` of an end tag, name, attributes) of each piece of markup; all but tags have no name."""
    at, quotes = 0, True
    while (m := _NEXT.search(html, at)) is not None:
        low, found = m.start(), None
        if m[1]:
            end = html.find("-->", low + 4)
            at = len(html) if end < 0 else end + 3
        else:
            end = html.find(">", low)
            if end < 0:
                at = len(html)
            elif html[low + 1] in "!?" or html[low : low + 2] == "</" and not html[low + 2 : low + 3].isalpha():
                at = end + 1
            else:
                found = _TAG.match(html, low) if quotes else None
                quotes = quotes and found is not None
                found = found or _PLAIN_TAG.match(html, low)
                at = found.end() if found else end + 1
        yield (low, at, found[1], found[2].lower(), found[3]) if found else (low, at, "", "", "")


class _Ends:
    """Places of end tags; a name without one after some place is not looked for again."""

    def __init__(self, html: str):
        self.html, self.missing = html, set()

    def after(self, name: str, at: int) -> int:
        """Where the next end tag of ``name`` is over; -1 without one."""
        if name in self.missing:
            return -1
        found = re.compile(rf"</{re.escape(name)}(?=[\s/>])", re.I).search(self.html, at)
        if found is None:
            self.missing.add(name)
            return -1
        end = self.html.find(">", found.end())
        return len(self.html) if end < 0 else end + 1


def blocks(html: str) -> list[tuple[str, int, float, int]]:
    """(text, words, link density, place) of each block that has text."""
    out: list[tuple[str, int, float, int]] = []
    stack: list[tuple[str, int]] = []
    opened: Counter[str] = Counter()
    parts: list[str] = []
    linked: list[str] = []
    place = links = at = 0
    in_head, ends = False, _Ends(html)

    def flush() -> None:
        text = " ".join(unescape("".join(parts)).split())
        if text:
            n = text.count(" ") + 1
            out.append((text, n, min(1.0, len(unescape(" ".join(linked)).split()) / n), place))
        parts.clear()
        linked.clear()

    def say(text: str) -> None:
        if text and not in_head:
            parts.append(text)
            if links:
                linked.append(text)

    for low, high, closing, name, attributes in tags(html):
        if low < at:  # within an element without text
            continue
        say(html[at:low])
        at = high
        if not name:
            continue
        if name in ("head", "body"):
            in_head = name == "head" and not closing
        if name in NO_TEXT and not closing and not attributes.endswith("/"):
            end = ends.after(name, at)
            if end >= 0 or name in TO_END:
                flush() if name in BLOCK else None
                at = end if end >= 0 else len(html)
                continue
        if name == "br":
            say(" ")
        elif name == "a":
            links = max(0, links + (-1 if closing else 1))
        if name in BLOCK:
            flush()
            links = links if closing else 0
        if name not in NESTED:
            continue
        if not closing and not attributes.endswith("/"):
            stack.append((name, place))
            opened[name] += 1
            inner = _place(name, attributes, place)
            if inner != place:
                flush()
            place = inner
        elif closing and opened[name]:
            while True:
                last, outer = stack.pop()
                opened[last] -= 1
                if last == name:
                    break
            if outer != place:
                flush()
            place = outer
    say(html[at:])
    flush()
    return out


def features(shape: list[tuple[int, float, int]]) -> list[tuple]:
    """Features of each block of a page; blocks are (words, link density, place)."""
    words: Counter[int] = Counter()
    for n, _, place in shape:
        words[place] += n
    total = max(1, words.total())
    home = (words[ARTICLE] + words[MAIN]) / total
    around = [(0, 0.0), *((n, d) for n, d, _ in shape), (0, 0.0)]
    return [(n, d, *around[i], *around[i + 2], place, words[place] / total, home) for i, (n, d, place) in enumerate(shape)]


_MENU = [(1, 1.0, BESIDES, 0), (2, 1.0, BESIDES, 0), (1, 1.0, BESIDES, 0), (3, 1.0, BESIDES, 0)]
_FOOT = [(14, 0.1, BESIDES, 0), (3, 1.0, BESIDES, 0)]
_BARE_MENU = [(1, 1.0, NONE, 0), (2, 1.0, NONE, 0), (4, 1.0, NONE, 0), (2, 1.0, NONE, 0)]
#: Labelled pages: blocks as (words, link density, place, 1 for content).
LABELLED = [
    # articles with menus, an advert, a sidebar, comments
    [*_MENU, (9, 0.0, HINT, 0), (8, 0.0, ARTICLE, 1), (60, 0.0, ARTICLE, 1), (35, 0.05, ARTICLE, 1), (5, 0.0, ARTICLE, 1), *_FOOT],
    [*_MENU, (12, 0.0, HINT, 0), (1, 0.0, ARTICLE, 1), (2, 0.0, ARTICLE, 1), *_FOOT],
    [(30, 0.0, HINT, 0), (6, 0.0, ARTICLE, 1), (120, 0.02, ARTICLE, 1), (18, 0.0, HINT, 0), (90, 0.0, ARTICLE, 1), (1, 0.0, ARTICLE, 1), (40, 0.0, BESIDES, 0), (80, 0.0, BESIDES, 0)],
    [(6, 0.0, ARTICLE, 1), (18, 0.5, ARTICLE, 1), (6, 1.0, ARTICLE, 1), (70, 0.0, ARTICLE, 1), (7, 0.14, ARTICLE, 1), (25, 0.0, COMMENTS, 0), (60, 0.0, COMMENTS, 0), (90, 0.0, COMMENTS, 0)],
    [(1, 0.0, ARTICLE, 1), (400, 0.0, ARTICLE, 1), (9, 1.0, ARTICLE, 1), (8, 1.0, ARTICLE, 1), (1, 1.0, ARTICLE, 0), (1, 1.0, ARTICLE, 0), (1, 1.0, ARTICLE, 0), (2, 1.0, BESIDES, 0)],
    [(3, 0.0, HINT, 0), (45, 0.0, HINT, 0), (4, 0.0, ARTICLE, 1), (30, 0.0, ARTICLE, 1), (50, 0.0, HINT, 0), (70, 0.0, HINT, 0), *_FOOT],
    [(12, 0.0, NONE, 0), (2, 0.0, NONE, 0), (7, 0.0, ARTICLE, 1), (80, 0.0, ARTICLE, 1), (44, 0.3, ARTICLE, 1), (5, 0.0, NONE, 0), (10, 0.2, NONE, 0)],
    [*_MENU, (10, 0.0, HINT, 0), (9, 0.0, ARTICLE, 1), (3, 0.0, ARTICLE, 1), (2, 0.0, ARTICLE, 1), (12, 0.0, ARTICLE, 1), (1, 0.0, ARTICLE, 1), (6, 0.0, ARTICLE, 1), (24, 0.0, ARTICLE, 1), (4, 0.0, ARTICLE, 1), (16, 0.1, BESIDES, 0)],
    [*_MENU, (13, 0.0, HINT, 0), (5, 0.0, ARTICLE, 1), (10, 0.0, ARTICLE, 1), (15, 0.0, ARTICLE, 1), (3, 0.0, ARTICLE, 1), (7, 0.0, ARTICLE, 1), *_FOOT],
    [*_MENU, (4, 0.0, HINT, 0), (2, 0.0, ARTICLE, 1), (3, 0.0, ARTICLE, 1), (5, 0.0, ARTICLE, 1), (10, 0.5, ARTICLE, 1), (14, 0.2, ARTICLE, 1), (2, 0.0, ARTICLE, 1), (3, 0.0, BESIDES, 0)],
    [(8, 0.0, HINT, 0), (15, 0.0, ARTICLE, 1), (200, 0.0, ARTICLE, 1), (3, 0.0, ARTICLE, 1), (12, 0.0, HINT, 0), (4, 0.0, ARTICLE, 1), (12, 1.0, ARTICLE, 1), (20, 0.9, ARTICLE, 1), (26, 0.0, HINT, 0), (9, 0.0, ARTICLE, 1)],
    [(8, 0.0, ARTICLE, 1), (40, 0.0, ARTICLE, 1), (5, 0.0, ARTICLE, 1), (7, 0.0, ARTICLE, 1), (6, 1.0, ARTICLE, 1), (4, 0.0, ARTICLE, 1), (8, 0.8, ARTICLE, 1), (2, 0.0, ARTICLE, 1), (3, 1.0, BESIDES, 0)],
    [(2, 0.0, ARTICLE, 1)],
    [(5, 0.0, ARTICLE, 1), (3, 0.0, ARTICLE, 1), (1, 0.0, ARTICLE, 1)],
    [(9, 0.0, ARTICLE, 1), (28, 0.0, ARTICLE, 1), (6, 0.0, ARTICLE, 1), (3, 0.3, ARTICLE, 1)],
    [*_MENU, (4, 0.0, ARTICLE, 1), (14, 0.0, ARTICLE, 1), (4, 0.0, ARTICLE, 1)],
    [(2, 0.0, MAIN, 1)],
    [(4, 0.0, MAIN, 1), (12, 0.0, MAIN, 1), (3, 0.0, MAIN, 1)],
    [*_MENU, (6, 0.0, MAIN, 1), (2, 0.0, MAIN, 1), (40, 0.0, MAIN, 1), (5, 0.0, MAIN, 1)],
    # main parts with lists of links
    [(1, 1.0, MAIN, 0), (2, 1.0, MAIN, 0), (3, 1.0, MAIN, 0), (4, 0.0, MAIN, 1), (55, 0.1, MAIN, 1), (22, 0.0, MAIN, 1), (4, 1.0, MAIN, 0), (5, 1.0, MAIN, 0), (3, 1.0, MAIN, 0)],
    [(6, 0.0, MAIN, 1), (33, 0.0, MAIN, 1), (4, 0.0, MAIN, 1), (6, 0.0, MAIN, 1), (20, 0.6, MAIN, 1), (5, 0.0, MAIN, 1), (3, 0.0, MAIN, 1), (2, 1.0, BESIDES, 0)],
    [(5, 0.0, MAIN, 1), (30, 0.3, MAIN, 1), (2, 0.0, MAIN, 1), (12, 0.0, MAIN, 1), (8, 0.9, MAIN, 0), (6, 1.0, MAIN, 0), *_FOOT],
    [(1, 0.0, MAIN, 1), (1, 0.0, MAIN, 1), (3, 0.0, MAIN, 1), (40, 0.0, COMMENTS, 0), (20, 0.0, HINT, 0)],
    [*_MENU, (6, 0.0, HINT, 0), (7, 0.0, MAIN, 1), (2, 0.0, MAIN, 1), (3, 0.0, MAIN, 1), (10, 0.0, MAIN, 1), (5, 0.0, MAIN, 1), (14, 0.2, MAIN, 1), (17, 0.5, MAIN, 1), (4, 0.0, MAIN, 1), (16, 0.0, HINT, 0)],
    [*_MENU, (3, 0.0, MAIN, 1), (150, 0.0, MAIN, 1), (11, 0.0, MAIN, 1), (35, 0.0, NONE, 1), (60, 0.0, NONE, 1), (9, 0.0, HINT, 0)],
    # no telling element
    [*_BARE_MENU, (4, 0.0, NONE, 1), (45, 0.0, NONE, 1), (90, 0.05, NONE, 1), (22, 0.0, NONE, 1), (8, 0.0, NONE, 1), (65, 0.0, NONE, 1), (6, 0.4, NONE, 0), (4, 0.6, NONE, 0), (3, 1.0, NONE, 0)],
    [(3, 1.0, NONE, 0), (2, 1.0, NONE, 0), (60, 0.0, NONE, 1), (50, 0.0, NONE, 1), (20, 0.8, NONE, 0), (14, 0.9, NONE, 0), (11, 1.0, NONE, 0)],
    [(150, 0.0, NONE, 1)],
    [(3, 0.0, NONE, 1), (70, 0.0, NONE, 1), (2, 0.0, NONE, 1), (30, 0.0, NONE, 1), (12, 0.0, NONE, 1), (9, 0.0, NONE, 1), (45, 0.0, NONE, 1)],
    [(6, 0.0, NONE, 1), (28, 0.0, NONE, 1), (5, 0.0, NONE, 1), (19, 0.0, NONE, 1), (33, 0.0, NONE, 1), (4, 0.0, BESIDES, 0)],
    [(2, 0.0, NONE, 0)],
    [(4, 0.0, NONE, 1), (80, 0.0, NONE, 1), (18, 0.0, NONE, 1), (40, 0.0, NONE, 1), (35, 0.2, NONE, 1), (3, 0.0, NONE, 0)],
    [(5, 0.0, NONE, 0), (1, 1.0, NONE, 0), (3, 0.0, NONE, 0), (2, 0.0, NONE, 0)],
    [(7, 0.0, NONE, 1), (25, 0.0, NONE, 1), (6, 0.0, NONE, 1), (70, 0.0, NONE, 1), (16, 0.0, NONE, 1), (55, 0.0, NONE, 1), (4, 1.0, NONE, 0)],
    # wrappers whose names hint at other things, around everything
    [(2, 1.0, HINT, 0), (3, 1.0, HINT, 0), (5, 0.0, HINT, 1), (70, 0.0, HINT, 1), (45, 0.05, HINT, 1), (24, 0.0, HINT, 1), (90, 0.0, HINT, 1), (2, 1.0, HINT, 0)],
    [*_MENU, (6, 0.0, HINT, 1), (120, 0.0, HINT, 1), (60, 0.1, HINT, 1), (30, 0.0, HINT, 1), *_FOOT],
    [(3, 0.0, HINT, 1), (30, 0.0, HINT, 1), (3, 0.0, HINT, 1), (50, 0.0, HINT, 1), (6, 0.0, HINT, 1), (20, 0.1, HINT, 1), (14, 0.1, BESIDES, 0)],
    [(1, 1.0, BESIDES, 0), (2, 0.0, HINT, 1), (35, 0.0, HINT, 1), (8, 0.0, HINT, 1), (150, 0.0, HINT, 1), (12, 0.0, HINT, 1), (40, 0.2, HINT, 1), (6, 0.0, BESIDES, 0)],
    [(9, 0.0, HINT, 0), (4, 0.0, HINT, 0), (1, 1.0, HINT, 0)],
    [(14, 0.0, HINT, 0), (8, 0.0, HINT, 0), (2, 1.0, BESIDES, 0), (30, 0.0, ARTICLE, 1), (24, 0.0, HINT, 0), (60, 0.0, HINT, 0), (90, 0.0, HINT, 0)],
    [(20, 0.0, HINT, 0), (45, 0.0, HINT, 0), (3, 0.0, MAIN, 1), (8, 0.0, MAIN, 1), (35, 0.1, HINT, 0), (14, 0.0, HINT, 0)],
    [(40, 0.0, NONE, 1), (12, 0.0, HINT, 0), (70, 0.0, NONE, 1), (16, 0.0, HINT, 0), (28, 0.0, HINT, 0)],
    # nothing but the rest
    [*_MENU, (60, 0.0, BESIDES, 0), (90, 0.05, BESIDES, 0), (35, 0.0, BESIDES, 0), *_FOOT],
    [(70, 0.0, COMMENTS, 0), (100, 0.0, COMMENTS, 0), (45, 0.0, COMMENTS, 0)],
    [*_BARE_MENU, (3, 0.0, NONE, 0), (4, 1.0, NONE, 0)],
]


def labelled() -> list[tuple]:
    """Features and label of each labelled block."""
    return [(*f, block[-1]) for page in LABELLED for f, block in zip(features([b[:-1] for b in page]), page, strict=True)]


def grow(rows: list[tuple], depth: int = 10):
    """A decision tree: the label, or (feature, threshold, tree up to it, tree above it)."""
    ones, n = sum(r[-1] for r in rows), len(rows)
    if depth == 0 or ones in (0, n):
        return int(2 * ones >= n)
    best = None
    for feature in range(len(rows[0]) - 1):
        column = sorted((r[feature], r[-1]) for r in rows)
        ones_low = 0
        for low, (a, b) in enumerate(zip(column[:-1], column[1:], strict=True), 1):
            ones_low += a[1]
            if a[0] == b[0]:
                continue
            # twice the products of the shares of both labels, weighed by rows
            cost = 2 * (ones_low * (low - ones_low) / low + (ones - ones_low) * (n - low - ones + ones_low) / (n - low))
            if best is None or cost < best[0] - 1e-9:
                best = (cost, feature, (a[0] + b[0]) / 2)
    if best is None:
        return int(2 * ones >= n)
    _, feature, cut = best
    return (feature, cut, grow([r for r in rows if r[feature] <= cut], depth - 1), grow([r for r in rows if r[feature] > cut], depth - 1))


@cache
def tree():
    return grow(labelled())


def classify(values: tuple, node) -> int:
    while not isinstance(node, int):
        feature, cut, low, high = node
        node = low if values[feature] <= cut else high
    return node


def main_text(html: str | None) -> str:
    found = blocks(html or "")
    return " ".join(text for (text, *_), f in zip(found, features([b[1:] for b in found]), strict=True) if classify(f, tree()))


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` (columns of these names are replaced)."""

    @F.pandas_udf("text string, n_chars long")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts = [main_text(x if isinstance(x, str) else None) for x in batch]
            yield pd.DataFrame({"text": texts, "n_chars": np.array([len(t) for t in texts], dtype=np.int64)}, index=batch.index)
        give_back()

    small_batches(pages.sparkSession)
    main = free_name(pages, "_main")
    kept = [F.col(f"`{c}`") for c in pages.columns if c not in ("text", "n_chars")]
    return pages.withColumn(main, run(F.col(f"`{html_col}`").cast("string"))).select(*kept, f"{main}.*")
