"""Main text of web pages: flat text blocks judged by a decision tree over shallow features.

A page is read once into a flat list of blocks, the texts between block-level tags. Each block is described by its
word count and link density, those of the blocks before and after it, whether it stands in an article, is a heading or,
outside an article, a copyright line, and by what is around it: an element that holds no article as a rule (nav, aside, form ...) or one
with a name like "sidebar". Such an element keeps its text out however much of it there is. Only where nothing but links
stands outside of them is the page taken to be wrapped in one, which then is looked into; reader comments and hidden
elements never are. A decision tree (Gini, depth at most 7), trained on the small labelled table below, says which blocks
are content. Scripts, styles, comments in the markup, form controls and embedded media never make blocks. Tags are read
as the HTML standard's tokenizer does.

Character references are decoded, white space inside a block becomes one space, blocks are joined in page order by
an empty line. Null and empty pages, and pages without content, give an empty text. Very long pages are read
in time proportional to their length. Repeated pages give equal rows; null ids and urls stay null; further columns of
the pages, whatever their names, don't reach the result. Tables without rows give no rows.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvane.llm.common import small_batches, table

# a name, then a value in quotes or without; a quote that is never closed runs to the page's end
_ATTRIBUTE = re.compile(r"""[\s/]*+([^\s/>][^\s/>=]*+)(?:\s*+=\s*+(?:"([^"]*+)(?:"|\Z)|'([^']*+)(?:'|\Z)|([^\s>"'][^\s>]*+)|(?=>)))?+""")
_TAG = re.compile(r"""<!--(?:-?>|.*?(?:--!?>|\Z))|<[!?][^>]*+>?|</(?![A-Za-z])[^>]*+>?|<(/?)([A-Za-z][^\s/>]*+)((?:[\s/]*+[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*+(?:"|\Z)|'[^']*+(?:'|\Z)|[^\s>"'][^\s>]*+|(?=>)))?+)*+[\s/]*+)>?""", re.S)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NOTICE = re.compile(r"(?i)\A\W*(?:©|\(c\)|copyright\s*(?:©|\(c\)|\d{4}))|\ball rights reserved\W*\Z")

# Names of elements by how they are read.
RAW = frozenset("script style textarea title xmp noembed noframes".split())
SKIPPED = frozenset("head noscript template select button iframe object svg math canvas audio video map option datalist label input".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - {"html", "body"}
OUTER = frozenset("nav footer aside menu".split())
FORMS = frozenset(("form", "dialog"))
CONTENT = frozenset(("article", "main"))
#: Words in a class, id or role that name what isn't the article.
OUTER_NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner sidebar widget widgets nav navbar navigation menu menubar breadcrumb breadcrumbs footer masthead topbar "
    "comment comments commentlist respond reply replies disqus discussion cookie cookies consent gdpr notice notices notification popup modal overlay newsletter subscribe subscription signup login "
    "search share sharing social related recommended recommendations pagination pager toolbar copyright disclaimer contentinfo complementary alert skip".split()
)
#: Those of them that name what readers wrote.
READERS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
#: Parts of a class that make it tell what an element has or how it is set, not what it is: "has-sidebar", "comments-open".
STATES = frozenset("has no not with without is hide hidden show open opened closed enabled disabled".split())

FEATURES = ("words", "links", "words_before", "links_before", "words_after", "links_after", "in_article", "has_article", "heading", "outer", "notice")
#: A split leaves at least so many rows on each side.
LEAST_ROWS = 2
#: Kinds of elements around a block that hold no article as a rule: by element, by name, forms; reader comments and what is hidden hold none ever.
NONE, ELEMENT, NAMED, FORM, NEVER = range(5)
#: Hand-labelled blocks: the features in order (link densities in percent; outer 0 none, 1 by element, 2 by name; notice: a copyright line outside an article), then 1 for content.
LABELLED = """
1 100 0 0 1 100 0 1 0 1 0 0
1 100 1 100 1 100 0 1 0 1 0 0
2 100 1 100 3 100 0 0 0 1 0 0
6 100 2 100 8 0 0 1 0 1 0 0
4 0 0 0 2 100 0 0 0 1 0 0
12 0 60 0 0 0 0 1 0 1 0 0
35 0 80 0 0 0 0 1 0 1 0 0
9 22 45 0 0 0 0 0 0 1 0 0
60 4 90 0 40 10 0 0 0 1 0 0
3 0 2 100 30 0 0 1 1 1 0 0
25 0 3 100 9 0 0 0 0 1 0 0
80 0 70 0 12 0 0 1 0 1 0 0
8 0 1 100 9 0 1 1 0 2 0 0
30 0 1 100 10 0 0 1 0 2 0 0
14 50 9 0 11 0 0 0 0 2 0 0
45 0 120 0 38 0 0 1 0 2 0 0
70 2 44 0 60 0 0 0 0 2 0 0
5 0 40 0 22 0 0 1 1 2 0 0
120 0 35 0 90 0 0 1 0 2 0 0
3 0 80 0 66 0 0 0 1 2 0 0
7 100 7 100 7 100 1 1 0 2 0 0
18 0 16 0 50 0 0 0 0 2 0 0
9 0 8 0 60 0 1 1 1 0 0 1
4 0 30 0 55 0 1 1 1 0 0 1
11 0 1 100 70 0 1 0 1 0 0 1
60 0 9 0 75 0 1 1 0 0 0 1
75 0 60 0 48 0 1 1 0 0 0 1
150 3 75 0 90 2 1 1 0 0 0 1
22 0 90 0 10 0 1 1 0 0 0 1
5 0 66 0 33 0 1 1 0 0 0 1
1 0 40 0 50 0 1 1 0 0 0 1
2 0 8 0 12 0 1 1 0 0 0 1
12 33 60 0 80 0 1 1 0 0 0 1
8 50 42 0 39 0 1 1 0 0 0 1
30 20 55 0 14 0 1 1 0 0 0 1
7 0 6 0 9 0 1 1 0 0 0 1
40 0 7 0 0 0 1 1 0 0 0 1
3 0 2 0 1 100 1 1 0 0 0 1
90 0 10 0 6 100 1 0 0 0 0 1
16 0 4 100 25 0 1 1 0 0 0 1
400 0 10 0 0 0 1 1 0 0 0 1
900 1 10 0 25 0 1 1 0 0 0 1
25 0 900 0 300 0 1 1 0 0 0 1
200 0 0 0 0 0 1 1 0 0 0 1
10 0 12 0 4 100 1 1 1 0 0 1
10 0 3 0 500 0 1 1 1 0 0 1
1 0 1 0 1 0 1 1 0 0 0 1
3 33 200 0 12 0 1 1 0 0 0 1
20 60 100 0 70 0 1 1 0 0 0 1
45 45 45 0 60 20 1 1 0 0 0 1
250 12 60 5 9 0 1 1 0 0 0 1
6 0 12 0 200 0 1 1 0 0 0 1
6 0 250 0 12 30 1 1 0 0 0 1
4 100 60 0 5 100 1 1 0 0 0 0
5 100 4 100 6 100 1 1 0 0 0 0
9 89 5 100 40 0 1 1 0 0 0 0
2 100 70 0 3 100 1 0 0 0 0 0
12 83 30 0 10 90 1 1 0 0 0 0
3 0 1 100 8 0 0 1 0 0 0 0
12 0 2 100 9 0 0 1 0 0 0 0
40 0 8 0 60 0 0 1 0 0 0 0
6 0 90 0 12 0 0 1 1 0 0 0
25 30 70 0 5 0 0 1 0 0 0 0
100 5 30 0 20 0 0 1 0 0 0 0
9 0 1 100 64 0 0 0 1 0 0 1
5 0 35 0 48 0 0 0 1 0 0 1
10 0 6 100 40 0 0 0 1 0 0 1
55 0 9 0 62 0 0 0 0 0 0 1
80 3 55 0 41 0 0 0 0 0 0 1
38 10 44 0 52 5 0 0 0 0 0 1
18 0 70 0 66 0 0 0 0 0 0 1
24 0 60 0 3 100 0 0 0 0 0 1
30 0 4 100 28 0 0 0 0 0 0 1
12 0 50 0 45 0 0 0 0 0 0 1
6 0 48 0 51 0 0 0 0 0 0 1
14 0 33 0 60 10 0 0 0 0 0 1
400 0 10 0 0 0 0 0 0 0 0 1
19 0 5 0 10 11 0 0 0 0 0 1
18 11 19 0 10 0 0 0 0 0 0 1
10 0 18 11 3 0 0 0 0 0 0 1
22 8 15 0 20 0 0 0 0 0 0 1
16 0 20 5 0 0 0 0 0 0 0 1
5 0 1 100 19 0 0 0 1 0 0 1
4 0 12 0 30 0 0 0 1 0 0 1
7 0 1 100 300 0 0 0 1 0 0 1
200 3 6 0 12 0 0 0 0 0 0 1
11 0 11 0 12 0 0 0 0 0 0 1
2 100 3 100 2 100 0 0 0 0 0 0
8 75 10 0 60 0 0 0 0 0 0 0
5 0 1 100 2 100 0 0 0 0 0 0
4 0 2 100 6 0 0 0 0 0 0 0
7 0 5 0 3 100 0 0 0 0 0 0
30 70 2 100 20 80 0 0 0 0 0 0
15 60 70 0 9 100 0 0 0 0 0 0
3 0 2 100 4 100 0 0 1 0 0 0
6 0 4 0 5 0 0 0 0 0 0 0
45 55 3 100 8 100 0 0 0 0 0 0
60 2 9 0 75 0 0 0 0 0 0 1
120 0 60 2 80 0 0 0 0 0 0 1
45 3 70 0 5 100 0 0 0 0 0 1
9 0 1 100 60 0 0 0 1 0 0 1
80 0 9 0 60 0 1 1 0 0 0 1
12 0 60 0 80 0 1 1 0 0 0 1
70 0 12 0 66 0 0 0 0 0 0 1
35 4 90 0 40 0 0 0 0 0 0 1
150 0 8 0 30 0 1 1 0 0 0 1
8 0 2 100 70 0 1 1 1 0 0 1
4 100 60 0 5 100 0 0 0 0 0 0
6 83 4 100 3 100 0 0 0 0 0 0
3 0 2 100 40 100 0 0 0 0 0 0
40 0 30 0 55 0 0 1 0 2 0 0
66 0 40 0 50 0 0 0 0 2 0 0
90 0 66 0 35 0 1 1 0 2 0 0
25 0 14 0 30 0 0 1 0 1 0 0
2 0 0 0 0 0 0 0 0 0 0 1
1 0 0 0 0 0 0 0 0 0 0 1
30 0 0 0 0 0 0 0 0 0 0 1
3 0 0 0 0 0 1 1 0 0 0 1
4 0 0 0 9 0 0 0 1 0 0 1
9 0 4 0 0 0 0 0 0 0 0 1
12 100 60 0 80 0 1 1 0 0 0 1
8 100 45 0 30 0 1 1 0 0 0 1
20 100 35 5 60 0 1 1 0 0 0 1
6 100 120 0 90 0 1 1 0 0 0 1
5 0 40 0 0 0 0 0 0 0 1 0
7 0 60 2 4 100 0 0 0 0 1 0
4 0 55 0 0 0 1 1 0 0 0 1
3 0 9 0 15 0 1 1 0 0 0 1
9 11 3 100 0 0 0 1 0 0 1 0
12 0 90 0 0 0 0 0 0 0 1 0
3 0 0 0 0 0 0 0 0 0 1 0
15 0 70 0 2 100 0 1 0 0 1 0
300 0 200 0 180 0 0 1 0 2 0 0
150 2 90 0 120 0 0 0 0 2 0 0
90 0 60 0 200 0 1 1 0 2 0 0
220 0 30 0 40 0 0 1 0 1 0 0
110 0 80 0 95 0 0 0 0 1 0 0
60 0 400 0 55 0 0 0 0 2 0 0
2 0 0 0 0 0 0 0 0 2 0 0
40 0 0 0 0 0 0 0 0 1 0 0
5 60 0 0 19 0 0 0 0 0 0 0
7 71 0 0 30 0 0 0 0 0 0 0
4 100 0 0 12 0 0 0 0 0 0 0
9 66 2 100 45 0 0 0 0 0 0 0
3 66 0 0 60 0 0 0 0 0 0 0
12 75 0 0 80 0 0 0 0 0 0 0
6 83 5 80 25 0 0 0 0 0 0 0
10 60 70 0 0 0 0 0 0 0 0 0
8 87 40 0 3 0 0 0 0 0 0 0
14 71 22 0 6 0 0 0 0 0 0 0
5 100 0 0 40 0 0 1 0 0 0 0
11 63 3 100 7 0 0 1 0 0 0 0
6 100 50 0 0 0 0 1 0 0 0 0
"""


@dataclass
class Node:
    """A split (feature <= threshold goes low) or a leaf."""

    share: float
    feature: int = -1
    threshold: float = 0.0
    low: "Node | None" = None
    high: "Node | None" = None

    def __call__(self, x: tuple) -> bool:
        node = self
        while node.low is not None:
            node = node.low if x[node.feature] <= node.threshold else node.high
        return node.share > 0.5


def grow(x: np.ndarray, y: np.ndarray, depth: int = 7) -> Node:
    """A decision tree by Gini impurity; of equally good splits the first, by feature and threshold."""
    share = float(y.mean()) if len(y) else 0.0
    best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
    if depth:
        for f in range(x.shape[1]):
            values = np.unique(x[:, f])
            for t in (values[1:] + values[:-1]) / 2:
                low = x[:, f] <= t
                if min(low.sum(), (~low).sum()) < LEAST_ROWS:
                    continue
                a, b = y[low].mean(), y[~low].mean()
                left = a * (1 - a) * low.sum() + b * (1 - b) * (~low).sum()
                if left < best[0]:
                    best = (left, f, float(t))
    if best[1] < 0:
        return Node(share)
    low = x[:, best[1]] <= best[2]
    return Node(share, best[1], best[2], grow(x[low], y[low], depth - 1), grow(x[~low], y[~low], depth - 1))


def train(labelled: str = LABELLED) -> Node:
    """The tree of a labelled table."""
    rows = np.array([[float(v) for v in line.split()] for line in labelled.strip().splitlines()])
    return grow(rows[:, :-1], rows[:, -1])


@dataclass
class Block:
    """A flat text block."""

    text: str
    words: int
    links: int
    in_article: int
    heading: int
    outer: int  # the innermost outer element around it, 0 for the page


@dataclass
class _Reader:
    blocks: list[Block] = field(default_factory=list)
    stack: list[tuple[str, bool, int]] = field(default_factory=list)  # open elements, whether each is an article, and the outer element before it or -1
    places: dict[str, list[int]] = field(default_factory=dict)  # by name, where in the stack its open elements are
    parts: list[str] = field(default_factory=list)
    parents: list[int] = field(default_factory=lambda: [-1])  # of outer elements; the page is the first
    kinds: list[int] = field(default_factory=lambda: [NONE])
    plain: list[int] = field(default_factory=lambda: [0])  # words outside links that stand right in each
    holds: list[bool] = field(default_factory=lambda: [False])  # whether an article begins right in each
    outer: int = 0
    linked: int = 0
    articles: int = 0
    anchors: int = 0
    heading: int = 0
    skipped: int = 0

    def text(self, raw: str) -> None:
        if not self.skipped and raw:
            t = html.unescape(raw)
            self.parts.append(t)
            if self.anchors:
                self.linked += len(t.split())

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            n = text.count(" ") + 1
            linked = min(n, self.linked)
            self.blocks.append(Block(text, n, 100 * linked // n, int(self.articles > 0), int(self.heading > 0), self.outer))
            self.plain[self.outer] += n - linked
        self.parts.clear()
        self.linked = 0

    def push(self, name: str, article: bool, kind: int) -> None:
        self.places.setdefault(name, []).append(len(self.stack))
        self.stack.append((name, article, self.outer if kind else -1))
        if kind:
            self.parents.append(self.outer)
            self.kinds.append(kind)
            self.plain.append(0)
            self.holds.append(False)
            self.outer = len(self.parents) - 1
        elif article:
            self.holds[self.outer] = True
        self.articles += article
        self.anchors += name == "a"
        self.skipped += name in SKIPPED
        self.heading += name in _HEADINGS

    def pop_to(self, k: int) -> None:
        while len(self.stack) > k:
            name, article, before = self.stack.pop()
            self.places[name].pop()
            if before >= 0:
                self.outer = before
            self.articles -= article
            self.anchors -= name == "a"
            self.skipped -= name in SKIPPED
            self.heading -= name in _HEADINGS

    def nearest(self, names: tuple[str, ...] | frozenset) -> int:
        """Where in the stack the nearest open element of ``names`` is, at any depth; -1 if none is open."""
        return max((own[-1] for name in names if (own := self.places.get(name))), default=-1)

    def close(self, names: tuple[str, ...] | frozenset, stop: frozenset) -> bool:
        """End the nearest open element of ``names``, unless one of ``stop`` is nearer."""
        k = self.nearest(names)
        if k < 0 or self.nearest(stop) > k:
            return False
        self.pop_to(k)
        return True

    def surroundings(self) -> list[int]:
        """By outer element, whether it or one around it keeps its text out: 0 no, 1 by element, 2 by name.

        An element that wraps the page doesn't: where nothing but links stands outside such elements, the one that holds
        an article, or else the form or oddly named element with the most text, is looked into instead, and so on.
        """
        children: dict[int, list[int]] = {}
        article, words = list(self.holds), list(self.plain)
        for k in range(len(self.parents) - 1, 0, -1):  # parents come first
            children.setdefault(self.parents[k], []).append(k)
            if self.kinds[k] != NEVER:
                article[self.parents[k]] |= article[k]
                words[self.parents[k]] += words[k]
        wraps, at = {0}, 0
        while not self.holds[at] and not self.plain[at]:
            inside = [k for k in children.get(at, []) if self.kinds[k] != NEVER and (article[k] or (self.kinds[k] != ELEMENT and words[k]))]
            if not inside:
                break
            at = max(inside, key=lambda k: (article[k], words[k], -k))
            wraps.add(at)
        out = [0] * len(self.parents)
        for k in range(1, len(out)):
            own = 0 if k in wraps else 1 if self.kinds[k] in (ELEMENT, FORM) else 2
            out[k] = max(out[self.parents[k]], own)
        return out


_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))
_SCOPE = frozenset("html body table td th div section article main nav aside header footer form blockquote ul ol dl li dd details figure".split())
_IMPLIED = {"li": (("li",), frozenset(("ul", "ol", "menu"))), "dt": (("dt", "dd"), frozenset(("dl",))), "dd": (("dt", "dd"), frozenset(("dl",))), "tr": (("tr",), frozenset(("table",))), "td": (("td", "th"), frozenset(("tr", "table"))), "th": (("td", "th"), frozenset(("tr", "table"))), "option": (("option",), frozenset(("select",)))}


def attributes_of(raw: str) -> dict[str, str]:
    """An element's attributes; the first of a name counts."""
    out: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(raw):
        out.setdefault(m.group(1).lower(), html.unescape(m.group(2) or m.group(3) or m.group(4) or ""))
    return out


def is_outer_name(token: str, whole: bool) -> bool:
    """Whether a class, id or role names what isn't the article; ``whole``: only as one word."""
    parts = [p.lower() for p in _PARTS.findall(token)]
    return token.lower() in OUTER_NAMES if whole else not STATES.intersection(parts) and not OUTER_NAMES.isdisjoint(parts)


def role_of(name: str, raw: str, in_article: bool) -> tuple[bool, int]:
    """Whether an element is an article, and what kind of outer element it is."""
    kind = FORM if name in FORMS else ELEMENT if name in OUTER or (name == "header" and not in_article) else NONE
    article = name in CONTENT
    if raw and name not in ("html", "body"):
        found = attributes_of(raw)
        role = found.get("role", "").strip().lower()
        article |= role in ("main", "article")
        style = found.get("style", "").replace(" ", "").lower()
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or "display:none" in style or "visibility:hidden" in style:
            return article, NEVER
        named = [token for key in ("class", "id", "role") for token in found.get(key, "").split() if is_outer_name(token, article)]
        if named and not (name == "main" or role == "main"):
            return article, NEVER if any(READERS.intersection(p.lower() for p in _PARTS.findall(t)) for t in named) else NAMED
    return article, kind


def read_page(page: str) -> _Reader:
    """The flat blocks of a page and what stands around them."""
    r, at = _Reader(), 0
    while (m := _TAG.search(page, at)) is not None:
        r.text(page[at : m.start()])
        at = m.end()
        name = (m.group(2) or "").lower()
        if not name:
            continue
        if m.group(1):
            if name in BLOCK:
                r.flush()
            if name == "br":
                r.text(" ")
            elif name not in VOID:
                r.close((name,), frozenset() if name in BLOCK else _SCOPE)
            continue
        if name in RAW:
            end = re.compile(rf"</{name}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        if name in BLOCK:
            r.flush()
            if name in CLOSES_P:
                r.close(("p", *_HEADINGS) if name in _HEADINGS else ("p",), _SCOPE)
        elif name in ("br", "wbr"):
            r.text(" " if name == "br" else "")
        if name in _IMPLIED:
            r.close(*_IMPLIED[name])
        if name == "a":
            r.close(("a",), _SCOPE)
        if name == "body":
            r.close(("head",), frozenset())
        if name in VOID or (m.group(3) or "").rstrip().endswith("/") and name in ("svg", "iframe"):
            continue
        r.push(name, *role_of(name, m.group(3) or "", r.articles > 0))
    r.text(page[at:])
    r.flush()
    return r


def describe(r: _Reader) -> list[tuple]:
    """The features of each block."""
    none = Block("", 0, 0, 0, 0, 0)
    around, outside = [none, *r.blocks, none], r.surroundings()
    has_article = int(any(h and not o for h, o in zip(r.holds, outside, strict=True)))  # one that isn't kept out
    return [(b.words, b.links, p.words, p.links, n.words, n.links, b.in_article, has_article, b.heading, outside[b.outer], int(not b.in_article and bool(_NOTICE.search(b.text)))) for p, b, n in zip(around, r.blocks, around[2:], strict=False)]


def main_text(page: str | None, tree: Node) -> str:
    """The main text of a page."""
    if not page:
        return ""
    r = read_page(page)
    return "\n\n".join(b.text for b, x in zip(r.blocks, describe(r), strict=True) if tree(x))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars (code points) of every page."""
    small_batches(pages.sparkSession)
    tree = train()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [main_text(p, tree) for p in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(run, "page_id long, url string, text string, n_chars long")


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The main text of every page."""
    return extract(table(spark, sf_dir, "pages"))
