"""Main text of web pages by wrapper induction.

Pages of one host are printed by one program: what stays the same from page to page
is its template, what varies is content.

* A page is parsed into a small tree; neighbours of one shape (a list's items, an
  article's paragraphs) are folded into one node.
* Trees of a host are aligned by simple tree matching: equal labels at the root, and
  for the children the order-preserving assignment that matches most nodes.  The
  aligned tree counts, node by node, the pages that have it and whether its text
  ever differs.
* Every task aligns the pages it reads, per host; the partial templates of a host are
  aligned with each other in two steps, so that a host with a third of all pages is
  never in one task.
* A page is then read through its host's template.  Nodes with one and the same text
  on all pages are template; varying nodes are slots.  The content is the lowest region
  that covers all slots of running text, with all it holds but the template;
  regions that their element, role or class names as menus, notices, adverts, forms,
  comments and the like are no content even where they vary.  A class or id names a
  region by its whole token or the token's head word, on boxes only, and not where the
  box holds most of the page's running text.

Text is judged constant only on a host with ``PAGES`` pages that have differing main
texts: on fewer pages nothing can be told apart, and the content is all main and article
elements, or without any the lowest region that covers all running text.

A null or empty page has an empty text.  Pages without a host form one group of
their own.  Repeated rows are extracted each; an empty table gives an empty result.  Very long and
very deep pages are read whole: a template looks ``DEEPEST`` elements deep, and what a box
at that depth holds is one text of it.  A template of more than ``NODES`` nodes loses those that
fewer than half of its pages have; they could not be constant, and their text stays.  Extra columns stay
but for ``html``; ``host``, ``template``, ``text`` and ``n_chars`` of the input are left out or replaced.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from html import unescape

import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weirline.llm.common import byte_slices, extended, stored
from weirline.llm.urlrules import url_host

PAGES = 5            # pages with differing texts before a constant text is template
HOSTS_HELD = 512     # templates held in a task before they are handed on: a memory bound
SALTS = 64           # first step of merging a host's partial templates
DEEPEST = 150        # levels of elements in a template: a bound of its recursion
NODES = 4096         # nodes of a host's template before rare ones are dropped: a memory bound
MOST_TEXT = 0.6      # share of the running text that overrules a name, or tells pages apart

# Element kinds of HTML, and names of regions that are no main text.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "template", "svg"}
BLOCK = set("address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
            "header hgroup hr html li main menu nav ol p pre search section summary table tbody td tfoot th thead tr ul caption".split())
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html"}
DROPPED = set("head script style noscript template svg iframe object nav aside footer form button select input textarea dialog menu search title".split())
DROPPED_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
DROPPED_NAMES = set("ad ads advert adverts advertisement advertising banner banners sponsor sponsored promo promotion nav navbar navigation menu menus breadcrumb breadcrumbs "
                    "masthead footer sidebar widget widgets cookie cookies consent notice notices gdpr popup modal overlay newsletter subscribe subscription signup login "
                    "share sharing social comment comments disqus replies reply related recommended recommendations pagination pager copyright legal skip".split())
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
UNNAMED = HEADINGS | {"html", "body", "main", "article", "p"}     # a class or id makes none of these noise
BOXES = set("html body main article section div center".split())   # what a region may be
# Words of a name that only say that it is a box; the word before them is its head.
BOX_WORDS = set("area bar block blocks body bottom box button buttons col column container content footer form group header inner item items left link links list "
                "message outer panel post posts right row section slot text title top unit wrap wrapper zone".split())
SIBLINGS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}}
BORDERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table", "tbody", "thead", "tfoot"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "option": {"select"}}

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:\"[^\"]*\"|'[^']*'|[^'\">])*)>", re.S)
_ATTR = re.compile(r"""(class|id|role|style|hidden|aria-hidden)\s*(?:=\s*("[^"]*"|'[^']*'|[^\s>]+))?""", re.I)
_OPEN_VALUE = re.compile(r"""=[^\s"']*/\Z""")   # <a href=/> ends with its value and closes nothing
_SPLIT = re.compile(r"[^a-z0-9]+")
_DIGITS = re.compile(r"\d+")


def names_noise(token: str) -> bool:
    """Does a class or id name a region that is no main text: as a whole or by its head word
    (``site-footer``, ``sidebar-left``, ``related-posts``, not ``no-sidebar`` or ``legal-basis``)?"""
    words = [w for w in _SPLIT.split(token) if w and not w.isdigit()]
    if not words or words[0] in ("no", "has", "with", "without", "not", "is"):
        return False
    while len(words) > 1 and words[-1] in BOX_WORDS - DROPPED_NAMES:
        words.pop()
    return words[-1] in DROPPED_NAMES


class Node:
    """An element; ``parts`` are its texts and child elements in page order.  ``noise``: no main
    text; ``named``: by no more than its class or id."""

    __slots__ = ("tag", "label", "noise", "named", "parts")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.parts = tag, []
        found = {k.lower(): (v or "").strip("\"'").lower() for k, v in _ATTR.findall(attrs)} if attrs else {}
        classes = found.get("class", "").split()
        # An id is one page's, and so are numbers in a class: neither tells apart what a template has.
        self.label = " ".join([tag, *sorted({_DIGITS.sub("", c) for c in classes} - {""})])
        told = tag in DROPPED or found.get("role") in DROPPED_ROLES or "hidden" in found or found.get("aria-hidden") == "true" \
            or "display:none" in found.get("style", "").replace(" ", "")
        self.named = not told and tag not in UNNAMED and any(map(names_noise, {*classes, *found.get("id", "").split()}))
        self.noise = told or self.named


def parse(html: str) -> Node:
    """A forgiving tree: end tags may lack, stray ones are passed over."""
    root = Node("html")
    path, at = [root], 0
    pos = 0
    while m := _TOKEN.search(html, pos):
        if m.start() > at:
            path[-1].parts.append(html[at:m.start()])
        pos = at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            for i in range(len(path) - 1, 0, -1):
                if path[i].tag == tag:
                    del path[i:]
                    break
                if tag not in BLOCK and path[i].tag in BLOCK:
                    break  # an inline end tag closes nothing beyond its block
            continue
        if tag in ("html", "body"):
            continue
        if tag in CLOSES_P:
            _close(path, {"p"}, BLOCK - {"p"})
        if tag in SIBLINGS:
            _close(path, SIBLINGS[tag], BORDERS[tag])
        if path[-1].tag == "head" and tag not in RAW | {"meta", "link", "base"}:
            path.pop()
        node = Node(tag, m[3])
        path[-1].parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(html, pos)
            pos = at = end.end() if end else len(html)
        elif tag not in VOID and not (m[3].endswith("/") and not _OPEN_VALUE.search(m[3])):
            path.append(node)
    if at < len(html):
        path[-1].parts.append(html[at:])
    _overrule(root)
    return root


def _overrule(root: Node) -> None:
    """A box that holds most of the running text is no noise for its name, unless a main or
    article element beside it has text of its own."""
    mass: dict[int, int] = {}
    framed: dict[int, int] = {}    # the part of it in main and article elements
    seen = [(root, False, False)]
    for n, link, frame in seen:
        frame = frame or n.tag in ("main", "article")
        own = 0 if link else sum(len(p.strip()) for p in n.parts if isinstance(p, str))
        mass[id(n)], framed[id(n)] = own, own if frame else 0
        seen += [(p, link or p.tag == "a", frame) for p in n.parts if isinstance(p, Node) and (p.named or not p.noise)]
    for n, _, _ in reversed(seen):    # children come after their parents
        for p in n.parts:
            if id(p) in mass:
                mass[id(n)] += mass[id(p)]
                framed[id(n)] += framed[id(p)]
    for n in (n for n, _, _ in seen if n.named):
        if mass[id(n)] and mass[id(n)] >= MOST_TEXT * mass[id(root)] and framed[id(root)] == framed[id(n)]:
            n.noise = False


def _close(path: list[Node], kinds: set[str], borders: set[str]) -> None:
    for i in range(len(path) - 1, 0, -1):
        if path[i].tag in kinds:
            del path[i:]
            return
        if path[i].tag in borders:
            return


def blocks(node: Node, skip: set[int] | None = None) -> list[str]:
    """The texts of the blocks below ``node`` in page order, without dropped regions."""
    out: list[str] = []
    line: list[str] = []

    def end() -> None:
        text = " ".join(unescape("".join(line)).split())
        if text:
            out.append(text)
        line.clear()

    path = [(node, iter(node.parts))]
    while path:
        inside, rest = path[-1]
        part = next(rest, None)
        if part is None:
            path.pop()
            if inside.tag in BLOCK:
                end()
        elif isinstance(part, str):
            line.append(part)
        elif part.noise or (skip and id(part) in skip):
            if part.tag in BLOCK:
                end()
        elif part.tag == "br":
            line.append(" ")
        else:
            if part.tag in BLOCK:
                end()
            path.append((part, iter(part.parts)))
    end()
    return out


# -- templates ---------------------------------------------------------------------
# A template node is [label, pages, digest of its text or None if it differs, children].

Owners = dict[int, tuple[list, list[Node]]]    # by id of a template node: the node, the elements folded into it


def folded(node: Node, where: Owners | None = None, depth: int = 1) -> list:
    """The page's tree as a template of one page.  ``where`` collects the elements of its nodes."""
    children: list[list] = []
    own: list[str] = []
    for part in node.parts:
        if isinstance(part, str):
            own.append(part)
        elif part.tag in BLOCK and not part.noise and depth < DEEPEST:
            child = folded(part, where, depth + 1)
            if children and children[-1][0] == child[0]:
                children[-1] = merged(children[-1], child, 0, where)
            else:
                children.append(child)
        elif not part.noise:
            own.append(" ".join(blocks(part)))
    text = " ".join(unescape("".join(own)).split())
    out = [node.label, 1, xxhash.xxh3_64_intdigest(text) if text else 0, children]
    if where is not None:
        where[id(out)] = (out, [node])
    return out


class Matching:
    """Simple tree matching: the children of two nodes are paired in order so that most nodes match.

    A pair of nodes is judged once; lives as long as the two trees that it compares."""

    def __init__(self) -> None:
        self.known: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def weight(self, a: list, b: list) -> int:
        """The most nodes that match below and at two nodes."""
        return self._of(a, b)[0] if a[0] == b[0] else 0

    def pairs(self, a: list, b: list) -> list[tuple[int, int]]:
        """The indices of the children paired."""
        return self._of(a, b)[1]

    def _of(self, a: list, b: list) -> tuple[int, list[tuple[int, int]]]:
        key = id(a), id(b)
        if key not in self.known:
            x, y = a[3], b[3]
            labels = [c[0] for c in x]
            if len(set(labels)) == len(x) and labels == [c[0] for c in y]:
                chosen = [(i, i) for i in range(len(x))]    # no other pairs are possible
            else:
                chosen = self._best(x, y)
            total = 1
            for i, j in chosen:
                total += self.weight(x[i], y[j])
            self.known[key] = total, chosen
        return self.known[key]

    def _best(self, x: list[list], y: list[list]) -> list[tuple[int, int]]:
        gain = [[0] * len(y) for _ in x]
        for i, c in enumerate(x):
            for j, d in enumerate(y):
                gain[i][j] = self.weight(c, d)
        most = [[0] * (len(y) + 1) for _ in range(len(x) + 1)]
        for i in range(len(x) - 1, -1, -1):
            for j in range(len(y) - 1, -1, -1):
                most[i][j] = max(most[i + 1][j], most[i][j + 1], most[i + 1][j + 1] + gain[i][j])
        out = []
        i = j = 0
        while i < len(x) and j < len(y):
            if gain[i][j] and most[i][j] == most[i + 1][j + 1] + gain[i][j]:
                out.append((i, j))
                i, j = i + 1, j + 1
            elif most[i][j] == most[i + 1][j]:
                i += 1
            else:
                j += 1
        return out


def matched(a: list[list], b: list[list]) -> list[tuple[int, int]]:
    """The index pairs of two lists of children."""
    return Matching().pairs(["", 1, 0, a], ["", 1, 0, b])


def merged(a: list, b: list, pages: int, where: Owners | None = None, match: Matching | None = None) -> list:
    """Align two templates of one root label.  ``pages`` = 1: their pages add up; 0: one page's
    neighbours are folded.  The result's nodes own the elements of both."""
    match = match or Matching()
    back = {j: i for i, j in match.pairs(a, b)}
    children, i = [], 0
    for j, y in enumerate(b[3]):
        if j in back:
            children += a[3][i:back[j]]
            children.append(merged(a[3][back[j]], y, pages, where, match))
            i = back[j] + 1
        else:
            children.append(y)
    children += a[3][i:]
    out = [a[0], a[1] + b[1] if pages else 1, a[2] if a[2] == b[2] else None, children]
    if where is not None:
        few, many = sorted((where[id(a)][1], where[id(b)][1]), key=len)
        many += few
        where[id(out)] = (out, many)
    return out


def n_nodes(tree: list) -> int:
    todo = [tree]
    for t in todo:
        todo += t[3]
    return len(todo)


def common(tree: list, pages: int) -> list:
    """The template without the nodes that fewer than half of ``pages`` have."""
    return [*tree[:3], [common(c, pages) for c in tree[3] if 2 * c[1] >= pages]]


def combine(a: dict, b: dict) -> dict:
    """Two partial templates of a host: {"tree", "texts"}; ``texts`` are a few digests of main texts."""
    tree = merged(a["tree"], b["tree"], 1)
    if n_nodes(tree) > NODES:
        tree = common(tree, tree[1])
    return {"tree": tree, "texts": sorted({*a["texts"], *b["texts"]})[:PAGES]}


def constant_nodes(page: list, tree: list, least: int, match: Matching | None = None) -> Iterator[int]:
    """ids of the page's template nodes whose text is the same on all of at least ``least`` pages."""
    match = match or Matching()
    for i, j in match.pairs(tree, page):
        t, p = tree[3][i], page[3][j]
        if t[2] and t[1] >= least and t[1] >= 0.9 * tree[1] and not t[3] and p[2] == t[2]:
            yield id(p)
        yield from constant_nodes(p, t, least, match)


def running_text(root: Node, links: Callable[[Node, Node, bool], bool], skip: set[int] | None = None) -> dict[int, int]:
    """Characters of text outside links by id of an element, without noise and ``skip``.
    ``links`` (parent, element, parent is in a link): is the element in a link?"""
    mass: dict[int, int] = {}
    seen = [(root, False)]
    for n, link in seen:
        mass[id(n)] = 0 if link else sum(len(p.strip()) for p in n.parts if isinstance(p, str))
        seen += [(p, links(n, p, link)) for p in n.parts if isinstance(p, Node) and not p.noise and not (skip and id(p) in skip)]
    for n, _ in reversed(seen):    # children come after their parents
        mass[id(n)] += sum(mass.get(id(p), 0) for p in n.parts)
    return mass


def outermost(root: Node, tags: tuple[str, ...], skip: set[int] | None = None) -> list[Node]:
    """The elements of ``tags`` in no other such element, in page order, without noise and ``skip``."""
    out, todo = [], [root]
    while todo:
        n = todo.pop()
        if n.tag in tags:
            out.append(n)
        else:
            todo += [p for p in reversed(n.parts) if isinstance(p, Node) and not p.noise and not (skip and id(p) in skip)]
    return out


def heaviest(root: Node) -> Node:
    """What tells a page from others: the article with most text, else the main element, else
    the smallest region that holds most of the running text outside links."""
    mass = running_text(root, lambda n, p, link: link or p.tag == "a")
    whole = mass[id(root)]
    tops = outermost(root, ("article",))
    if tops:
        return max(tops, key=lambda n: mass[id(n)])
    mains = outermost(root, ("main",))
    if mains:
        return mains[0]
    here = root
    while whole:
        inner = [p for p in here.parts if isinstance(p, Node) and p.tag in BLOCK and not p.noise]
        heavy = max(inner, key=lambda p: mass[id(p)], default=None)
        if heavy is None or mass[id(heavy)] < MOST_TEXT * whole or heavy.tag in ("p", "li", "td", "blockquote", "pre"):
            break
        here = heavy
    return here


def content(root: Node, skip: set[int] | None = None) -> list[Node]:
    """The regions of the main text.  ``skip``: the elements that the host's template knows as
    constant; the region is the lowest box that covers all other running text.  None: no
    template is known, and the outermost main and article elements are the regions, if any.

    Running text is text outside links, and headings."""
    mass = running_text(root, lambda n, p, link: n.tag not in HEADINGS and p.tag not in HEADINGS and (link or p.tag == "a"), skip)
    tops = outermost(root, ("main", "article"), skip)

    def lowest(n: Node) -> Node:
        while True:
            inner = [p for p in n.parts if isinstance(p, Node) and mass[id(n)] and mass.get(id(p)) == mass[id(n)]]
            if not inner or inner[0].tag not in BOXES:
                return n
            n = inner[0]

    if tops and (skip is None or not mass[id(root)]):
        return [lowest(n) for n in tops]
    return [lowest(root)]


def main_text(html: str | None, template: dict | None) -> str:
    if not html:
        return ""
    root = parse(html)
    skip: set[int] | None = None
    if template and len(template["texts"]) >= PAGES:
        where: Owners = {}
        tree = folded(root, where)
        skip = {id(n) for t in constant_nodes(tree, template["tree"], PAGES) for n in where[t][1]}
    return "\n\n".join(b for region in content(root, skip) for b in blocks(region, skip))


def page_template(html: str) -> dict:
    root = parse(html)
    text = "\n\n".join(blocks(heaviest(root)))
    return {"tree": folded(root), "texts": [xxhash.xxh3_64_intdigest(text)]}


def host_templates(pages: DataFrame, html_col: str) -> DataFrame:
    """(host, template): one JSON template per host of ``pages`` (host, html)."""

    def induce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict] = {}

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array([json.dumps(t) for t in held.values()], pa.string())],
                                              names=["host", "template"])

        for batch in batches:
            for part in byte_slices(batch, html_col):
                for host, html in zip(part.column("host").to_pylist(), part.column(html_col).to_pylist()):
                    if html:
                        own = page_template(html)
                        held[host] = combine(held[host], own) if host in held else own
                if len(held) > HOSTS_HELD:
                    yield out()
                    held.clear()
        if held:
            yield out()

    def merge(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        total = None
        for text in rows["template"]:
            total = json.loads(text) if total is None else combine(total, json.loads(text))
        return pd.DataFrame({"host": [key[0]], "template": [json.dumps(total)]})

    partial = pages.select("host", html_col).mapInArrow(induce, "host string, template string")
    salted = partial.withColumn("salt", F.pmod(F.xxhash64("template"), F.lit(SALTS)))
    return salted.groupBy("host", "salt").applyInPandas(merge, "host string, template string") \
        .groupBy("host").applyInPandas(merge, "host string, template string")


def extract(pages: DataFrame, url_col: str = "url", html_col: str = "html") -> DataFrame:
    """``pages`` without its html, plus text and n_chars (clashing columns are replaced)."""
    base = pages.drop("host", "template", "text", "n_chars").withColumn("host", url_host(F.col(url_col)))
    templates = stored(host_templates(base, html_col), "templates")
    joined = base.join(templates, "host", "left")
    kept = [c for c in joined.columns if c not in (html_col, "template", "host")]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, dict] = {}
        for batch in batches:
            for part in byte_slices(batch, html_col):
                texts = []
                for host, template, html in zip(*(part.column(c).to_pylist() for c in ("host", "template", html_col))):
                    if host not in known:
                        if len(known) > HOSTS_HELD:
                            known.clear()
                        known[host] = json.loads(template) if template else None
                    texts.append(main_text(html, known[host]))
                yield pa.RecordBatch.from_arrays([*[part.column(c) for c in kept], pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())],
                                                 names=[*kept, "text", "n_chars"])

    return joined.mapInArrow(read, extended(joined.select(*kept), "text string", "n_chars long"))
