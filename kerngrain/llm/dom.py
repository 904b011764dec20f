"""A small DOM for a page at a time: forgiving parsing, simple tree matching, and text blocks."""

from __future__ import annotations

import math
import re
import sys
from collections.abc import Iterator
from html import unescape

import numpy as np

sys.setrecursionlimit(max(sys.getrecursionlimit(), 100_000))  # nested pages; frames of Python code are on the heap

# Element names of the HTML standard by their role here.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split())
CLOSES_P = BLOCK - frozenset("dd dt body html tbody td tfoot th thead tr legend summary".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",)}
SCOPE = frozenset("ul ol dl table body html article section div main aside nav footer header form td th select".split())
HIDDEN = frozenset("head script style noscript template iframe object embed svg canvas audio video form button select option textarea input label nav footer aside dialog menu".split())
# Words in class, id and role attributes that name what is not the article.
ROLES = frozenset("ad ads adv advert adverts advertisement advertising sponsor sponsored promo promotion banner cookie cookies consent notice notices alert popup modal overlay menu nav navbar navigation breadcrumb breadcrumbs pagination pager header masthead footer sidebar widget widgets related recommended share sharing social toolbar subscribe subscription newsletter signup login search comment comments reply replies disqus respond tags copyright disclaimer skip".split())
MAIN = frozenset("article main".split())
# Elements whose content has no tags; that of TEXT has character references.
RAW, TEXT = frozenset("script style iframe noembed noframes xmp".split()), frozenset("textarea title".split())
_UNFINISHED = re.compile(r"<[a-zA-Z/!?][^<>]*\Z")
#: A start tag with its attributes, an end tag, or a comment or declaration. No part is taken back once it has matched, so that a search is linear;
#: a tag whose quotes don't close ends at the next ">".
_TAG = re.compile(r"""<(?:([a-zA-Z][^\s/>]*+)((?>[^>"'=]++|=\s*+"[^"]*+"|=\s*+'[^']*+'|["'=])*+)>|([a-zA-Z][^\s/>]*+)([^>]*+)>|/([a-zA-Z][^\s/>]*+)[^>]*+>|!--(?:-?>|.*?(?:--!?>|\Z))|[!?/][^>]*+(?:>|\Z))""", re.S)
_WHOLE = re.compile(r"<!---?>\Z|<!--.*--!?>\Z|<[!?/](?!--).*>\Z", re.S)
_ATTRIBUTE = re.compile(r"""([^\s/>="']+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>]*)))?""")
_NAMED = re.compile("class|id|role", re.I)
#: Up to so many cells a table of an alignment is kept whole.
CELLS = 1 << 22


class Node:
    __slots__ = ("tag", "key", "words", "children", "kids", "parent", "at")

    def __init__(self, tag: str, attributes: str, parent: Node | None) -> None:
        named: dict[str, str] = {}
        if _NAMED.search(attributes):
            for x in _ATTRIBUTE.finditer(attributes):
                name = x[1].lower()
                if name in ("class", "id", "role") and name not in named:
                    named[name] = unescape(x[2] or x[3] or x[4] or "")
        self.words = frozenset(re.findall(r"[a-z0-9]+", " ".join(named.values()).lower())) if named else frozenset()
        self.tag, self.parent, self.children, self.kids, self.at = tag, parent, [], [], -1
        self.key = (tag, named.get("class", ""))

    def elements(self) -> list[Node]:
        return self.kids

    def own_text(self) -> str:
        return " ".join(" ".join(x for x in self.children if isinstance(x, str)).split())

    def apart(self) -> bool:
        """Whether the element's name or attributes say that it isn't part of the article.

        Inside article and main all words of class, id and role must say so, elsewhere one is enough.
        """
        if self.tag in HIDDEN or self.tag == "header" and not self.within(MAIN):
            return True
        if not self.words & ROLES or self.tag in ("html", "body") or self.tag in MAIN:
            return False
        return self.words <= ROLES if self.within(MAIN) else True

    def within(self, tags: frozenset) -> bool:
        x = self.parent
        while x is not None:
            if x.tag in tags:
                return True
            x = x.parent
        return False


class _Builder:
    def __init__(self) -> None:
        self.root = self.top = Node("#page", "", None)

    def _close(self, tags: tuple[str, ...], until: frozenset) -> None:
        x = self.top
        while x is not None and x.tag not in tags:
            if x.tag in until:
                return
            x = x.parent
        if x is not None and x.parent is not None:
            self.top = x.parent

    def start(self, tag: str, attributes: str) -> None:
        if tag in CLOSES_P:
            self._close(("p",), SCOPE)
        if tag in SIBLINGS:
            self._close(SIBLINGS[tag], SCOPE)
        node = Node(tag, attributes, self.top)
        self.top.children.append(node)
        self.top.kids.append(node)
        if tag not in VOID:
            self.top = node

    def end(self, tag: str) -> None:
        if tag not in VOID:
            self._close((tag,), frozenset() if tag in BLOCK else SCOPE)

    def data(self, data: str) -> None:
        self.top.children.append(unescape(data) if "&" in data else data)


def parse(html: str | None) -> Node:
    text, builder, at = _UNFINISHED.sub("", html or ""), _Builder(), 0
    end_of_tags = text.rfind(">") + 1  # behind it no tag can end
    while found := _TAG.search(text, at, end_of_tags):
        if found.start() > at:
            builder.data(text[at : found.start()])
        at = found.end()
        name = found[1] or found[3]
        if name:
            tag = name.lower()
            builder.start(tag, found[2] if found[1] else found[4])
            if tag in RAW or tag in TEXT:
                end = re.compile(rf"</{tag}[\s/>]", re.I).search(text, at)
                stop = end.start() if end else len(text)
                if tag in TEXT:
                    builder.data(text[at:stop])
                at = stop
        elif found[5]:
            builder.end(found[5].lower())
        elif at == end_of_tags and not _WHOLE.match(found[0]):
            at = len(text)  # a comment without an end
    if at < len(text):
        rest = text[at:]
        broken = re.search(r"<[!?/]", rest) if at >= end_of_tags else None
        builder.data(rest[: broken.start()] if broken else rest)
    stack, n = [builder.root], 0
    while stack:  # page order
        x = stack.pop()
        x.at, n = n, n + 1
        stack.extend(reversed(x.kids))
    return builder.root


class Shapes:
    """Shapes of subtrees, keys and children, as numbers: equal subtrees have equal numbers."""

    def __init__(self) -> None:
        self.numbers: dict[tuple, int] = {}
        self.keys: list[tuple] = []
        self.kids: list[tuple[int, ...]] = []
        self.sizes: list[int] = []
        self.scores: dict[tuple[int, int], int] = {}

    def of(self, top: Node) -> dict[int, int]:
        """The shape of every node below top, by its place in the page."""
        order, stack, found = [], [top], {}
        while stack:
            x = stack.pop()
            order.append(x)
            stack.extend(x.kids)
        for x in reversed(order):
            kids = tuple([found[y.at] for y in x.kids])
            n = self.numbers.setdefault((x.key, kids), len(self.keys))
            if n == len(self.keys):
                self.keys.append(x.key)
                self.kids.append(kids)
                self.sizes.append(1 + sum([self.sizes[y] for y in kids]))
            found[x.at] = n
        return found

    def score(self, x: int, y: int) -> int:
        """The most pairs that two subtrees of equal key can have; once for each pair of shapes."""
        if x == y:
            return self.sizes[x]
        p, q = self.kids[x], self.kids[y]
        if not p or not q:
            return 1
        known = self.scores.get((x, y))
        if known is None:
            known = self.scores[x, y] = 1 + self.aligned(p, q)
        return known

    def aligned(self, p: tuple[int, ...], q: tuple[int, ...]) -> int:
        head, tail = common(p, q)
        total = sum([self.sizes[x] for x in p[:head]]) + sum([self.sizes[x] for x in p[len(p) - tail :]])
        p, q = p[head : len(p) - tail], q[head : len(q) - tail]
        if not p or not q:
            return total
        row = None
        for row in self.rows(p, q):
            pass
        return total + int(row[-1])

    def rows(self, p: tuple[int, ...], q: tuple[int, ...], row: list | np.ndarray | None = None) -> Iterator:
        """The rows of the table of an alignment after the first, or those after ``row``."""
        if len(p) * len(q) < 2500:
            keys = [self.keys[y] for y in q]
            before = [0] * (len(q) + 1) if row is None else row
            for x in p:
                now, key, last = [0], self.keys[x], 0
                for j, k in enumerate(keys):
                    if before[j + 1] > last:
                        last = before[j + 1]
                    if k == key:
                        s = before[j] + self.score(x, q[j])
                        if s > last:
                            last = s
                    now.append(last)
                yield now
                before = now
            return
        some, place = np.unique(np.array(q), return_inverse=True)
        shapes = some.tolist()
        before = np.zeros(len(q) + 1, dtype=np.int32) if row is None else row
        gains: dict[int, np.ndarray] = {}
        for x in p:
            if x not in gains:
                if len(gains) >= 64:
                    gains.clear()
                gains[x] = np.array([self.score(x, y) if self.keys[x] == self.keys[y] else 0 for y in shapes], dtype=np.int32)[place]
            now = np.zeros(len(q) + 1, dtype=np.int32)
            now[1:] = np.maximum.accumulate(np.maximum(before[1:], before[:-1] + gains[x]))
            yield now
            before = now

    def path(self, p: tuple[int, ...], q: tuple[int, ...]) -> list[tuple[int, int]]:
        """Places of children that are paired. Of a large table every so many rows are kept, and those between are made again on the way back."""
        step = max(1, len(p) if len(p) * len(q) <= CELLS else math.isqrt(len(p)) + 1)
        first = [0] * (len(q) + 1) if len(p) * len(q) < 2500 else np.zeros(len(q) + 1, dtype=np.int32)
        kept = {0: first}
        if step < len(p):
            for i, row in enumerate(self.rows(p, q), 1):
                if i % step == 0:
                    kept[i] = row
        out, j = [], len(q)
        small = len(p) * len(q) < 2500
        for begin in range((len(p) - 1) // step * step, -1, -step):
            part = p[begin : begin + step]
            start = kept[begin] if small or len(part) * len(q) >= 2500 else kept[begin].tolist()  # a short rest goes cell by cell
            table = [start, *self.rows(part, q, start)]
            i = len(part)
            while i and j:
                if table[i][j] == table[i - 1][j]:
                    i -= 1
                elif table[i][j] == table[i][j - 1]:
                    j -= 1
                else:
                    i, j = i - 1, j - 1
                    out.append((begin + i, j))
        return out


def common(p: tuple[int, ...], q: tuple[int, ...]) -> tuple[int, int]:
    """How many shapes two lists begin with and how many more they end with alike. A largest alignment pairs these: in any other, one pair
    at most has to give way to such a pair, which counts as much as a subtree can."""
    n = min(len(p), len(q))
    if p[:n] == q[:n]:
        return n, 0
    head = next(i for i in range(n) if p[i] != q[i])
    tail = 0
    while tail < n - head and p[-1 - tail] == q[-1 - tail]:
        tail += 1
    return head, tail


def match(a: Node, b: Node) -> list[tuple[Node, Node]]:
    """Simple tree matching: pairs of nodes of equal key that keep order and ancestry, as many as possible.

    Equal subtrees are paired as they are, at the begin and end of a list at once; scores are kept by shapes, and tables only while their path is followed.
    """
    shapes = Shapes()
    of_a, of_b = shapes.of(a), shapes.of(b)
    out, stack = [], [(a, b)]
    while stack:
        x, y = stack.pop()
        out.append((x, y))
        if not x.kids or not y.kids:
            continue
        p, q = shapes.kids[of_a[x.at]], shapes.kids[of_b[y.at]]
        head, tail = common(p, q)
        n, m = len(p) - tail, len(q) - tail
        pairs = [(i, i) for i in range(head)] + [(n + i, m + i) for i in range(tail)]
        if head < n and head < m:
            pairs += [(head + i, head + j) for i, j in shapes.path(p[head:n], q[head:m])]
        stack.extend((x.kids[i], y.kids[j]) for i, j in pairs)
    return out


def blocks(top: Node, skip, mute: set[int] | frozenset = frozenset()) -> list[str]:
    """The texts of the blocks below a node in page order, without the nodes that skip() names and the own text of those in mute."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        text = " ".join("".join(line).split())
        line.clear()
        if text:
            out.append(text)

    stack: list = [(top, False)]
    while stack:
        x, done = stack.pop()
        if isinstance(x, str):
            line.append(x)
        elif done:
            flush()
        elif x is top or not skip(x):
            if x.tag in ("br", "wbr", "img"):
                line.append(" " if x.tag == "br" else "")
                continue
            if x.tag in BLOCK or x is top:
                flush()
                stack.append((x, True))
            stack.extend((" " if x.at in mute and isinstance(y, str) else y, False) for y in reversed(x.children))
    flush()
    return out
