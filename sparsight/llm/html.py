"""Main text of web pages by a tree-structured graphical model over the DOM.

A page becomes a tree: block elements inside, runs of text as leaves. Every node is content or not. A node's own evidence
comes from features (tag, names in class, id and role, length, links, punctuation), a child's label leans on its parent's
by a learned potential. Sum-product messages, one pass from the leaves up and one from the root down, give each node's
exact marginal; the runs that are more likely content than not are the text. Potentials are counts, smoothed, of labelled
pages (`labelled_pages`), which are composed here and bounded by TRAINING_PAGES.
"""

from __future__ import annotations

import bisect
import functools
import html
import math
import re
from collections import Counter
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import table
from .labelled_pages import MARK, labelled_pages

TRAINING_PAGES = 600
SEED = 7
THRESHOLD = 0.5
#: Elements that stay within a run of text; their text belongs to the block around them.
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose start ends an open paragraph; and those that end an open sibling of the kinds named.
CLOSES_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "option": ("option",)}
#: What an implied end doesn't reach through.
SCOPE = frozenset("table ul ol dl body html article section div main aside nav header footer form".split())
#: Elements that hold no readable text at all, ends included, and comments, declarations and tags.
_MARKUP = re.compile(
    r"<!--.*?(?:-->|\Z)|<(script|style|noscript|template|svg|title|iframe|textarea|object|select|audio|video|canvas)\b[^>]*>.*?(?:</\1\s*>|\Z)|<[!?][^>]*>"
    r"""|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|</?[a-zA-Z][^>]*+>""",
    re.DOTALL | re.IGNORECASE,
)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")
_NAME_PARTS = re.compile(r"[a-z]+")
_NAMING = frozenset(("class", "id", "role", "aria-label", "itemprop"))


class Tree(NamedTuple):
    """Nodes in page order; a parent comes before its children. text is None for elements."""

    parent: list[int]
    tag: list[str]
    names: list[tuple[str, ...]]
    text: list[str | None]
    linked: list[int]
    marked: list[bool]


def parse(page: str) -> Tree:
    """The tree of a page, whatever its mark-up; its root is node 0."""
    tree = Tree([-1], ["html"], [()], [None], [0], [False])
    stack = [0]
    open_at: dict[str, list[int]] = {}  # where in the stack each tag's open elements are, without the root
    run: list[str] = []
    linked = 0
    in_link = False

    def flush():
        nonlocal linked
        if run:
            text = " ".join("".join(run).split())
            if text:
                tree.parent.append(stack[-1])
                tree.tag.append(tree.tag[stack[-1]])
                tree.names.append(())
                tree.text.append(text)
                tree.linked.append(min(linked, len(text)))
                tree.marked.append(tree.marked[stack[-1]])
            run.clear()
        linked = 0

    def close(k: int):
        for node in stack[k:]:
            open_at[tree.tag[node]].pop()
        del stack[k:]

    def add(raw: str):
        nonlocal linked
        if raw:
            text = html.unescape(raw) if "&" in raw else raw
            run.append(text)
            if in_link:
                linked += len(text)

    at = 0
    # behind the last > no tag can end, and looking for one from every < would take squared time
    last, m = page.rfind(">") + 1, None
    for m in _MARKUP.finditer(page, 0, last):
        add(page[at : m.start()])
        at = m.end()
        tag = m[3]
        if not tag:
            continue
        tag = tag.lower()
        if m[2]:
            if tag == "a":
                in_link = False
            elif tag not in INLINE and tag not in VOID:
                if open_at.get(tag):
                    flush()
                    close(open_at[tag][-1])
            continue
        if tag == "a":
            in_link = True
        elif tag in VOID:
            run.append(" ")
            if tag == "hr":
                flush()
        elif tag not in INLINE and tag not in ("html", "head"):
            flush()
            ends = SIBLINGS.get(tag, ("p",) if tag in CLOSES_P else ())
            if any(open_at.get(e) for e in ends):
                # the lowest of these that no other scope's element is above
                scope = max((open_at[t][-1] for t in SCOPE if t not in ends and open_at.get(t)), default=0)
                lowest = min((open_at[e][i] for e in ends if open_at.get(e) and (i := bisect.bisect(open_at[e], scope)) < len(open_at[e])), default=None)
                if lowest is not None:
                    close(lowest)
            names, marked = [], False
            attributes = m[4]
            if attributes and not attributes.isspace():
                for a in _ATTRIBUTE.finditer(attributes):
                    key = a[1].lower()
                    if key in _NAMING:
                        names += _NAME_PARTS.findall((a[2] or a[3] or a[4] or "").lower())
                    elif key == "hidden":
                        names.append("hidden")
                    elif key == MARK:
                        marked = True
            tree.parent.append(stack[-1])
            tree.tag.append(tag)
            tree.names.append(tuple(names))
            tree.text.append(None)
            tree.linked.append(0)
            tree.marked.append(marked)
            open_at.setdefault(tag, []).append(len(stack))
            stack.append(len(tree.parent) - 1)
    unended = m and m.end() == last and (m[1] and not re.search(rf"</{m[1]}\s*>\Z", m[0], re.IGNORECASE) or m[0].startswith("<!--") and not m[0].endswith("-->"))
    if not unended:
        add(page[at:].partition("<!--")[0])
    flush()
    return tree


def extents(tree: Tree) -> tuple[list[int], list[int]]:
    """Characters of text, and of linked text, in every node and all below it."""
    size = [len(t) if t is not None else 0 for t in tree.text]
    linked = list(tree.linked)
    for k in range(len(size) - 1, 0, -1):
        size[tree.parent[k]] += size[k]
        linked[tree.parent[k]] += linked[k]
    return size, linked


def _links(size: int, linked: int) -> int:
    return 0 if not linked else 1 if linked < 0.35 * size else 2 if linked < 0.8 * size else 3


def features(tree: Tree, k: int, size: list[int], linked: list[int]) -> list[str]:
    """What is seen of node k itself; size and linked are its tree's extents."""
    tag, text = tree.tag[k], tree.text[k]
    links = _links(size[k], linked[k])
    if text is None:
        return [f"tag {tag} {links}", *{f"name {n}" for n in tree.names[k]}]
    n = len(text)
    return [
        f"in {tag} {links}",
        f"length {0 if n < 10 else 1 if n < 30 else 2 if n < 80 else 3 if n < 250 else 4}",
        f"ends {text[-1] in '.!?…:;' or text[-1] in '»”' + chr(34)}",
        f"rights {'©' in text[:40]}",
    ]


class PageModel:
    """Potentials of nodes and of parent-child pairs, and inference by them."""

    def __init__(self, pages: list[str]):
        seen: list[Counter] = [Counter(), Counter()]
        nodes = [Counter(), Counter()]
        moves = {(up, inner): [1.0, 1.0] for up in (0, 1) for inner in (False, True)}
        for page in pages:
            tree = parse(page)
            size, linked = extents(tree)
            label = [bool(t is not None and m) for t, m in zip(tree.text, tree.marked)]
            for k in range(len(label) - 1, 0, -1):
                if label[k]:
                    label[tree.parent[k]] = True
            for k in range(1, len(label)):
                inner = tree.text[k] is None
                nodes[label[k]][inner] += 1
                seen[label[k]].update((inner, f) for f in features(tree, k, size, linked))
                moves[label[tree.parent[k]], inner][label[k]] += 1
        #: Log odds of content by feature, of text runs and of elements; features never seen tell nothing.
        self.weight = {}
        for inner, f in {*seen[0], *seen[1]}:
            yes, no = ((seen[y][inner, f] + 0.5) / (nodes[y][inner] + 1) for y in (1, 0))
            self.weight[f] = math.log(yes / no)
        #: log P(child content | parent) and its complement, by parent label and whether the child is an element.
        self.move = {key: (math.log(no / (no + yes)), math.log(yes / (no + yes))) for key, (no, yes) in moves.items()}

    def marginals(self, tree: Tree) -> list[float]:
        """P(content) of every node, by sum-product up and down the tree."""
        n = len(tree.parent)
        weight, parent = self.weight, tree.parent
        size, linked = extents(tree)
        own = [0.0] * n  # log evidence for content over not, node and all below it
        for k in range(1, n):
            own[k] = sum(weight.get(f, 0.0) for f in features(tree, k, size, linked))
        to_parent = [0.0] * n  # log message for content over not
        log0 = [0.0] * n
        up0, up1 = [0.0] * n, [0.0] * n
        for k in range(n - 1, 0, -1):
            a = own[k]
            inner = tree.text[k] is None
            (n0, y0), (n1, y1) = self.move[0, inner], self.move[1, inner]
            up0[k], up1[k] = _log_add(n0, y0 + a), _log_add(n1, y1 + a)
            to_parent[k] = up1[k] - up0[k]
            own[parent[k]] += to_parent[k]
        out = [0.0] * n  # log odds of the marginal
        out[0] = own[0]
        for k in range(1, n):
            # what the parent believes without this child
            rest = out[parent[k]] - to_parent[k]
            inner = tree.text[k] is None
            (n0, y0), (n1, y1) = self.move[0, inner], self.move[1, inner]
            log0[k] = _log_add(y0, y1 + rest) - _log_add(n0, n1 + rest)
            out[k] = own[k] + log0[k]
        return [1 / (1 + math.exp(-x)) if x > -700 else 0.0 for x in out]

    def extract(self, page: str) -> str:
        """The page's content runs, in order, two line feeds apart."""
        tree = parse(page)
        return "\n\n".join(t for t, p in zip(tree.text, self.marginals(tree)) if t is not None and p >= THRESHOLD)


def _log_add(x: float, y: float) -> float:
    return x + math.log1p(math.exp(y - x)) if x > y else y + math.log1p(math.exp(x - y))


@functools.lru_cache(maxsize=2)
def trained(pages: int = TRAINING_PAGES, seed: int = SEED) -> PageModel:
    """The model of so many labelled pages; the same in every process."""
    return PageModel(labelled_pages(pages, seed))


def main_text(column: Column, pages: int = TRAINING_PAGES, seed: int = SEED) -> Column:
    """The main text of a column of HTML; empty for null and for pages without any."""
    model = trained(pages, seed)

    @F.arrow_udf("string")
    def text(found: pa.Array) -> pa.Array:
        return pa.array([model.extract(p).encode("utf-8", "replace").decode() if p else "" for p in found.to_pylist()], pa.string())

    return text(column)


def op8_dom_marginals(spark, sf_dir: str) -> DataFrame:
    """Main text of every whole page; null html counts as empty, rows that repeat are kept, an empty table gives no rows."""
    pages = table(spark, sf_dir, "pages")
    return pages.select("page_id", "url", main_text(F.col("html")).alias("text")).select("*", F.char_length("text").cast("long").alias("n_chars"))


def evaluate(model: PageModel, pages: list[str]) -> float:
    """Share of text runs of labelled pages that the model gets right."""
    right = []
    for page in pages:
        tree = parse(page)
        right += [(p >= THRESHOLD) == m for t, m, p in zip(tree.text, tree.marked, model.marginals(tree)) if t is not None]
    return float(np.mean(right))
