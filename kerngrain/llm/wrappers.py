"""Main text of web pages by wrapper induction: the pages of a host are aligned with one of them by simple tree matching.

1. The pages of a host fall into layouts by the smallest hash of their tags and classes; a layout of one distinct text goes with
the host's largest. Every layout has a pivot, the page with the smallest hash (ties: the smallest html). 2. Every page is
aligned with its layout's pivot. For each node of the pivot, votes count how often it was matched, how often its own text was
the same, and how many characters of text it had. Of pages of a host with the same text without tags one votes. 3. The
wrapper: own text of a node that is the same on nearly all pages that match the node, at least half of the layout's, is
template; the rest are slots. The main slot is the deepest node that holds nearly all text of slots outside what element names
and attributes mark as apart (menus, headers, footers, sidebars, notices, adverts, forms, comments). Pages that share nearly all
their text are copies of each other, not of one template, and have none. 4. Every page is aligned once more; its
text is what the main slot's match holds, without marked parts and without the template's own text; what varies below
a template node stays, and so do constant words inside a running line that varies. Inside ``article`` and ``main``, template
takes three pages: two may be copies. A page whose main slot finds no match or is the page or body as a whole, and a host
of fewer than ``least_pages`` distinct texts, go by ``article`` or ``main`` and else the body.

Votes are summed by host and node before they are shuffled, pivots are one row per layout, and the join of pages with
wrappers has a written table on either side, so that AQE splits a host with many pages.

Edge cases: null or empty html has no text. A url that is null or has no host shares the host "". Repeated rows and null
ids stay as they are. Truncated and malformed markup is parsed as far as it goes. Very long pages are used whole; further columns
are not looked at.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import written
from .dom import BLOCK, MAIN, Node, blocks, match, parse

EXTRACTED = "page_id string, url string, text string, n_chars long"


class Pivots:
    """Parsed pivots of the hosts met last."""

    def __init__(self, most: int = 200) -> None:
        self.known: dict[str, Node] = {}
        self.most = most

    def of(self, html: str) -> Node:
        if html not in self.known:
            if len(self.known) >= self.most:
                self.known.clear()
            self.known[html] = parse(html)
        return self.known[html]


def _hosted(pages: DataFrame) -> DataFrame:
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]*)", 1))
    # ids go through Python as text: pandas would make doubles of integers with nulls among them
    return pages.select(F.col("page_id").cast("long").cast("string").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))


def _layouts(pages: DataFrame) -> DataFrame:
    """pages with layout, the smallest hash of their tags and classes, and words, a hash of their text without tags."""
    html = F.lower("html")
    # data in script and style, and attributes, may differ on each visit of a page
    words = F.trim(F.regexp_replace(F.regexp_replace(html, r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " "), r"\s+", " "))
    keys = F.concat(F.regexp_extract_all(html, F.lit(r"<([a-z][a-z0-9]*)"), F.lit(1)), F.regexp_extract_all(html, F.lit(r"\sclass\s*=\s*[\"']?([^\"'>]*)"), F.lit(1)))
    layout = F.array_min(F.transform(F.array_distinct(keys), lambda x: F.xxhash64(F.lit("layout"), x)))
    return pages.withColumn("layout", F.coalesce(layout, F.lit(0))).withColumn("words", F.xxhash64(words))


def induce(pages: DataFrame, constant: float = 0.9, least_pages: int = 2, share: float = 0.8, matching: float = 0.5, least_varying: float = 0.1) -> tuple[DataFrame, DataFrame]:
    """Pages with host, layout and words to their groups, (host, layout, grp), and wrappers, (host, grp, pivot, template, main).

    template and main are places of nodes in the pivot, main -1 if none.
    """
    pages = pages.where("html is not null")
    copies = written(pages.groupBy("host", "layout", "words").agg(F.count("*").alias("copies")), "copies")
    sizes = copies.groupBy("host", "layout").agg(F.count("*").alias("texts"))
    largest = sizes.groupBy("host").agg(F.max_by("layout", F.struct("texts", "layout")).alias("largest"))
    groups = written(sizes.join(largest, "host").select("host", "layout", F.when(F.col("texts") > 1, F.col("layout")).otherwise(F.col("largest")).alias("grp")), "groups")
    # pivots are of the layout that names the group
    pivots = pages.groupBy("host", F.col("layout").alias("grp")).agg(F.min_by("html", F.struct(F.xxhash64("html"), "html")).alias("pivot"))
    pivots = written(pivots.join(groups.select("host", "grp").distinct(), ["host", "grp"], "left_semi"), "pivots")

    def vote(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pivots()
        for pdf in batches:
            votes = []
            for html, pivot in zip(pdf["html"], pdf["pivot"], strict=True):
                rows = [(-1, 0, 0)]
                for x, y in match(known.of(pivot), parse(html)):
                    text = y.own_text()
                    rows.append((x.at, x.own_text() == text, len(text)))
                votes.append(np.array(rows, dtype="<i4").tobytes())
            yield pdf[["host", "grp", "words"]].assign(votes=votes)

    def summed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for (host, grp), part in pdf.groupby(["host", "grp"]):
                rows = np.frombuffer(b"".join(part["votes"]), dtype="<i4").reshape(-1, 3)
                at, place = np.unique(rows[:, 0], return_inverse=True)
                same, chars = (np.bincount(place, weights=rows[:, k]) for k in (1, 2))
                yield pd.DataFrame({"host": host, "grp": grp, "at": at, "matched": np.bincount(place).astype(float), "same": same, "chars": chars})

    joined = pages.select("host", "layout", "words", "html").join(groups, ["host", "layout"]).join(pivots, ["host", "grp"]).select("host", "grp", "words", "html", "pivot")
    # one page for each distinct text: of a page some hundred bytes are shuffled, and its html only where pivots are too large to broadcast
    each = joined.mapInPandas(vote, "host string, grp long, words long, votes binary").groupBy("host", "grp", "words").agg(F.min("votes").alias("votes"))
    votes = each.select("host", "grp", "votes").mapInPandas(summed, "host string, grp long, at int, matched double, same double, chars double")
    votes = votes.groupBy("host", "grp", "at").agg(*[F.sum(c).alias(c) for c in ("matched", "same", "chars")])
    per_group = votes.groupBy("host", "grp").agg(F.sort_array(F.collect_list(F.struct("at", "matched", "same", "chars"))).alias("nodes"))  # a pivot's nodes

    def wrap(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        little = 1e-6  # sums of shares
        for pdf in batches:
            rows = []
            for host, grp, pivot, nodes in zip(pdf["host"], pdf["grp"], pdf["pivot"], pdf["nodes"], strict=True):
                found = {n["at"]: n for n in nodes}
                total = found.get(-1, {"matched": 0})["matched"] + little
                root = parse(pivot)
                order, chars, fixed = [], Counter(), {}
                stack = [root]
                while stack:
                    x = stack.pop()
                    n = found.get(x.at)
                    if n and x.own_text() and total >= least_pages and n["matched"] + little >= max(3 if x.tag in MAIN or x.within(MAIN) else 2, matching * total) and n["same"] + little >= constant * n["matched"]:
                        fixed[x.at] = n["chars"]
                    elif n:
                        chars[x.at] += n["chars"]
                    order.append(x)
                    stack.extend(y for y in x.elements() if not y.apart())
                if sum(chars.values()) < least_varying * (sum(chars.values()) + sum(fixed.values())):
                    chars.update(fixed)
                    fixed = {}
                for x in reversed(order):  # children before parents
                    if x.parent is not None:
                        chars[x.parent.at] += chars[x.at]
                main, x = -1, root
                while total >= least_pages and chars[root.at] and x is not None:
                    main = x.at
                    inner = [y for y in x.elements() if not y.apart() and chars[y.at] >= share * chars[root.at]]
                    x = inner[0] if inner and inner[0].tag not in ("p", "b", "i", "em", "strong", "span", "a") else None
                rows.append((host, grp, pivot, sorted(fixed), main))
            yield pd.DataFrame(rows, columns=["host", "grp", "pivot", "template", "main"])

    wrapped = pivots.join(per_group, ["host", "grp"]).mapInPandas(wrap, "host string, grp long, pivot string, template array<int>, main int")
    return groups, written(wrapped, "wrappers")


def _main_of(page: Node) -> Node:
    """The article or main element that isn't within a part set apart, the one of most text; else the page."""
    found, stack = [], [page]
    while stack:
        x = stack.pop()
        if x.tag in MAIN:
            found.append(x)
        else:
            stack.extend(y for y in reversed(x.elements()) if not y.apart())
    skip = Node.apart
    return max(found, key=lambda x: sum(map(len, blocks(x, skip))), default=page)


def _running(x: Node, constant: set[int]) -> bool:
    """Whether an inline node is within a line whose own text varies."""
    while x.tag not in BLOCK and x.parent is not None:
        x = x.parent
        if x.own_text() and x.at not in constant:
            return True
    return False


def text_of(page: Node, pivot: Node | None, template: set[int], main: int) -> str:
    same, top = [], None
    if pivot is not None and main >= 0:
        for x, y in match(pivot, page):
            if x.at == main:
                top = y
            if x.at in template and x.own_text() == y.own_text():
                same.append(y)
    constant = {y.at for y in same}
    mute = {y.at for y in same if not _running(y, constant)}
    if top is None or top.tag in ("#page", "html", "body"):
        top = _main_of(page)
    return "\n".join(blocks(top, Node.apart, mute))


def extract(pages: DataFrame, **parameters: float) -> DataFrame:
    """pages with page_id, url and html to EXTRACTED."""
    hosted = written(_layouts(_hosted(pages)), "hosted")  # three passes read it
    groups, wrappers = induce(hosted, **parameters)
    joined = hosted.drop("words").join(groups, ["host", "layout"], "left").join(wrappers, ["host", "grp"], "left")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = Pivots()
        for pdf in batches:
            texts = []
            for html, pivot, template, main in zip(pdf["html"], pdf["pivot"], pdf["template"], pdf["main"], strict=True):
                whole = isinstance(pivot, str)
                texts.append(text_of(parse(html), known.of(pivot) if whole else None, set(template) if whole else set(), int(main) if whole else -1) if html else "")
            yield pd.DataFrame({"page_id": pdf["page_id"], "url": pdf["url"], "text": texts, "n_chars": [len(x) for x in texts]})

    return joined.select("page_id", "url", "html", "pivot", "template", "main").mapInPandas(run, EXTRACTED).withColumn("page_id", F.col("page_id").cast("long"))
