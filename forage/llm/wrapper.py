"""Main text of web pages by wrapper induction.

Pages of a host are laid out by one program, in a few layouts.  Their trees of
block elements are aligned by simple tree matching with a reference page of
their layout, and with one of the host; a text that stands in the same node on
most of the distinct pages so aligned belongs to the template, a node whose
text varies is a slot for content.  Navigation, forms,
adverts, comments and the like are known by their elements and class names, so
single pages are cleaned too.

A page is parsed once, and its tree and texts are written; trees, not pages,
travel between tasks: a tree has a few bytes per node.
Counting template texts begins before the shuffle, so a host with a third of
all pages is no larger than any other after it.
"""

from __future__ import annotations

import hashlib
import html
import math
import re
from bisect import bisect_left
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from forage.llm.frames import set_aside
from forage.session import cut

#: A text is template if it stands in its node on so many distinct pages of the host or layout, and on this share of those aligned with the reference.
TEMPLATE_PAGES, TEMPLATE_SHARE = 4, 0.6
#: Trees are aligned if at least this share of the smaller one's nodes match.
ALIGNED = 0.5

# Elements of HTML by what they mean for text.
INLINE = set("a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title noscript template iframe svg math object xmp".split())
DROPPED = set("nav footer aside form button select option dialog menu head canvas audio video".split()) | RAW
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"}, "p": {"p"}}
BARRIERS = {"li": {"ul", "ol", "menu"}, "dt": {"dl"}, "dd": {"dl"}, "tr": {"table"}, "td": {"table"}, "th": {"table"}, "option": {"select"}, "p": {"article", "body", "div", "section", "td", "li"}}
CLOSE_P = set("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul".split())
ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar".split())
NOISE = re.compile(
    r"(?:^|[_-])(?:nav|navbar|navigation|menu|menubar|breadcrumbs?|sidebar|side|footer|ads?|advert|adverts|advertisement|adsense|banner|promo|promotion|sponsor|sponsored|cookies?|consent|gdpr"
    r"|notice|popup|modal|overlay|newsletter|subscribe|subscription|signup|comments?|commentlist|respond|disqus|share|sharing|social|related|recommended|widget|login|toolbar|pagination|pager|skip|masthead)(?:$|[_-])",
    re.I,
)
LAYOUT = re.compile(r"^(?:has|with|without|no|is|js)[_-]|[_-](?:has|with|without|no)[_-]", re.I)
HEADER = re.compile(r"(?:^|[_-])(?:header|site-header|page-header|topbar)(?:$|[_-])", re.I)
#: Elements whose paths from the root tell layouts apart; others come and go with the content.
SECTIONS = set("# html body div section article main header footer nav aside form table center hgroup".split())
BODY = re.compile(r"(?:^|[_-])(?:article-?body|article|content|main|post|entry|story)(?:$|[_-])", re.I)

_TAG = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*>", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))|(?<![\w=\"'-])(hidden)(?![\w=-])")


@dataclass
class Node:
    tag: str
    name: str
    parent: int
    dropped: bool
    article: bool
    main: bool
    body: bool
    inline: bool


@dataclass
class Block:
    node: int
    place: int
    text: str


class Page:
    """Block elements of a page, and its texts in order; each text knows its element and its place in it."""

    def __init__(self, source: str):
        self.nodes = [Node("#", "", -1, False, False, False, False, False)]
        self.blocks: list[Block] = []
        self._stack = [0]
        self._held: list[str] = []
        self._owner = 0
        self._places: dict[int, int] = {}
        self._parse(source)

    def _flush(self) -> None:
        if self._held:
            text = " ".join(html.unescape("".join(self._held)).split())
            self._held.clear()
            if text:
                place = self._places[self._owner] = self._places.get(self._owner, -1) + 1
                self.blocks.append(Block(self._owner, place, text))

    def _text(self, text: str) -> None:
        node = self._stack[-1]
        if self.nodes[node].dropped != self.nodes[self._owner].dropped or not self._held:
            self._flush()
            self._owner = self._block(node)
        self._held.append(text)

    def _block(self, node: int) -> int:
        """The nearest block element, or a dropped inline element on the way to it."""
        while self.nodes[node].inline and not (self.nodes[node].dropped and not self.nodes[self.nodes[node].parent].dropped):
            node = self.nodes[node].parent
        return node

    def element(self, node: int) -> int:
        """The nearest block element."""
        while self.nodes[node].inline:
            node = self.nodes[node].parent
        return node

    def _open(self, tag: str, rest: str) -> None:
        if tag not in INLINE:
            self._flush()
        for closing in ({"p"} if tag in CLOSE_P else set()) | CLOSES.get(tag, set()):
            self._close(closing, BARRIERS.get(closing, set()))
        if tag == "body":
            self._close("head")
        if tag == "br":
            if self._held:
                self._held.append(" ")
            return
        if tag in VOID:
            return
        parent = self.nodes[self._stack[-1]]
        values = {}
        if rest:
            for m in _ATTRIBUTE.finditer(rest):
                values.setdefault((m[1] or m[5]).lower(), m[2] or m[3] or m[4] or "")
        name = f"{values.get('class', '')} {values.get('id', '')}".strip()
        article = parent.article or tag == "article"
        main = parent.main or tag == "main" or values.get("role") == "main"
        inside = article or main
        dropped = parent.dropped or tag in DROPPED or values.get("role") in ROLES or "hidden" in values or "display:none" in values.get("style", "").replace(" ", "")
        if not dropped and name and tag not in ("body", "html", "article", "main"):
            dropped = any(not LAYOUT.search(n) and (NOISE.search(n) or (not inside and HEADER.search(n))) for n in name.split())
        dropped = dropped or (tag == "header" and not inside)
        body = parent.body or any(BODY.search(n) for n in name.split()) or values.get("itemprop") == "articleBody"
        self.nodes.append(Node(tag, name, self._stack[-1], dropped, article, main, body and tag not in ("body", "html"), tag in INLINE))
        number = len(self.nodes) - 1
        self._stack.append(number)

    def _close(self, tag: str, barriers: set[str] = frozenset()) -> None:
        for k in range(len(self._stack) - 1, 0, -1):
            name = self.nodes[self._stack[k]].tag
            if name == tag:
                if any(self.nodes[n].tag not in INLINE for n in self._stack[k:]):
                    self._flush()
                del self._stack[k:]
                return
            if name in barriers:
                return

    def _parse(self, source: str) -> None:
        at = 0
        while m := _TAG.search(source, at):
            if m.start() > at:
                self._text(source[at : m.start()])
            at = m.end()
            if m[2] is None:
                continue
            tag = m[2].lower()
            if m[1]:
                self._close(tag)
                continue
            self._open(tag, m[3])
            if tag in RAW and not m[3].rstrip().endswith("/"):
                end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
                self._close(tag)
                at = end.end() if end else len(source)
            elif m[3].rstrip().endswith("/") and tag not in VOID:
                self._close(tag)
        if at < len(source):
            self._text(source[at:])
        self._flush()

    def content(self) -> list[Block]:
        """Blocks that elements and names do not rule out: of the article, else of the main element, else of a content element, else of the page."""
        left = [b for b in self.blocks if not self.nodes[b.node].dropped]
        for part in ("article", "main", "body"):
            inside = [b for b in left if getattr(self.nodes[b.node], part)]
            if inside:
                return inside
        return left

    def tree(self) -> list[tuple[int, int]]:
        """(node, parent) of block elements, parents first."""
        return [(n, self.element(self.nodes[n].parent) if n else -1) for n, node in enumerate(self.nodes) if not node.inline]


def layout_of(page: Page) -> int:
    """A name of the page's layout: which paths of sections it has, numbers in their names aside; never ``WHOLE_HOST``."""
    paths = [0] * len(page.nodes)
    known: dict[tuple, int] = {}
    for k, node in enumerate(page.nodes):
        above = paths[node.parent] if k else 0
        step = above, node.tag, node.name
        if node.tag in SECTIONS and step not in known:
            known[step] = _hash(f"{above}/{node.tag}.{re.sub('[0-9]+', '', node.name)}")
        paths[k] = known.get(step, above)
    return _hash(" ".join(map(str, sorted(set(paths))))) or 1


def _hash(text: str) -> int:
    """A 63-bit name of a text that is the same in every process."""
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "replace"), digest_size=8).digest(), "big") >> 1


@dataclass
class Tree:
    """labels: tag and class of each block element; parents; sizes and shapes of the subtrees."""

    labels: list[int]
    parents: list[int]

    def __post_init__(self):
        n = len(self.labels)
        self.children: list[list[int]] = [[] for _ in range(n)]
        for k in range(1, n):
            self.children[self.parents[k]].append(k)
        self.size, self.shape = [1] * n, [0] * n
        for k in range(n - 1, -1, -1):
            self.size[k] += sum(self.size[c] for c in self.children[k])
            self.shape[k] = hash((self.labels[k], *(self.shape[c] for c in self.children[k])))


def tree_of(page: Page) -> tuple[Tree, dict[int, int]]:
    """The tree, and the place in it of each block element."""
    rows = page.tree()
    place = {n: k for k, (n, _) in enumerate(rows)}
    labels = [_hash(f"{page.nodes[n].tag}.{page.nodes[n].name}") for n, _ in rows]
    return Tree(labels, [place[p] if p >= 0 else -1 for _, p in rows]), place


#: Children of two nodes with more pairs than this are matched by rows of arrays instead of lists, with the same result.
MOST_PAIRS = 1 << 14


def _in_order(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest part of pairs, ordered by their first, whose seconds rise too."""
    tops: list[int] = []
    ends: list[int] = []
    before: list[int] = []
    for k, (_, y) in enumerate(pairs):
        at = bisect_left(tops, y)
        before.append(ends[at - 1] if at else -1)
        tops[at : at + 1], ends[at : at + 1] = [y], [k]
    k = ends[-1] if ends else -1
    found = []
    while k >= 0:
        found.append(pairs[k])
        k = before[k]
    return found[::-1]


class _Level:
    """Nodes of one depth of a tree, one of each shape, and their scores against nodes of another tree."""

    #: Rows kept for shapes met again have no more numbers than this.
    KEPT = 1 << 21

    def __init__(self, tree: Tree, nodes: list[int]):
        self.place: dict[int, int] = {}
        own = []
        for y in nodes:
            if tree.shape[y] not in self.place:
                self.place[tree.shape[y]] = len(own)
                own.append(y)
        self.labels = np.array([tree.labels[y] for y in own], dtype=np.int64)
        self.known = set(self.labels.tolist())
        self.kept: dict[int, np.ndarray] = {}
        self.below: _Level | None = None
        self.sizes = np.array([len(tree.children[y]) for y in own])
        self.children = [c for y in own for c in tree.children[y]]

    @classmethod
    def of(cls, tree: Tree, nodes: list[int]) -> _Level:
        """The level of the nodes with all levels below it."""
        top = level = cls(tree, nodes)
        while level.children:
            level.below = cls(tree, level.children)
            level.at = np.array([level.below.place[tree.shape[c]] for c in level.children], dtype=np.int64)
            level.owner = np.repeat(np.arange(len(level.sizes)), level.sizes)
            level.first = np.concatenate([[True], level.owner[1:] != level.owner[:-1]])
            level.last = (np.cumsum(level.sizes) - 1)[level.sizes > 0]
            level = level.below
        return top

    def start(self) -> np.ndarray | None:
        return np.zeros(len(self.at), dtype=np.int64) if self.below else None

    def step(self, row: np.ndarray, gain: np.ndarray, high: int) -> np.ndarray:
        """The next row of all tables at once.

        The tables stand one after another, each lifted above the last, so that a running maximum stays inside its table.
        """
        before = np.roll(row, 1)
        before[self.first] = 0
        lift = self.owner * high
        return np.maximum.accumulate(np.maximum(row, before + gain[self.at]) + lift) - lift

    def scores(self, row: np.ndarray | None, label: int) -> np.ndarray:
        total = np.ones(len(self.labels), dtype=np.int64)
        if row is not None:
            total[self.sizes > 0] += row[self.last]
        return np.where(self.labels == label, total, 0)

    def against(self, tree: Tree, x: int) -> np.ndarray:
        """Size of the largest map between the subtree of ``x`` and that of each node."""
        high = tree.size[x] + 1
        todo = [(self, x, iter(tree.children[x]), [self.start()])]
        found: np.ndarray | None = None
        while todo:
            level, node, rest, row = todo[-1]
            if found is not None:
                row[0] = level.step(row[0], found, high)
                found = None
            for child in rest if level.below else ():
                if tree.labels[child] in level.below.known:
                    found = level.below.kept.get(tree.shape[child])
                    if found is None:
                        todo.append((level.below, child, iter(tree.children[child]), [level.below.start()]))
                    break
            else:
                found = level.scores(row[0], tree.labels[node])
                if (len(level.kept) + 1) * len(found) > level.KEPT:
                    level.kept.clear()
                level.kept[tree.shape[node]] = found
                todo.pop()
        return found


def _matched_lists(a: Tree, b: Tree, xs: list[int], ys: list[int]) -> tuple[int, list[tuple[int, int]]]:
    """Size of the largest order-keeping map of two long lists of siblings, and its pairs of siblings.

    Rows of the table are arrays.  Every k-th row is kept, k the root of their
    number, and the rows between are computed anew on the way back, so memory
    grows with the list and not with its square.
    """
    level = _Level.of(b, ys)
    at = np.array([level.place[b.shape[y]] for y in ys], dtype=np.int64)

    def gain(x: int) -> np.ndarray | None:
        if a.labels[x] not in level.known:
            return None
        known = level.kept.get(a.shape[x])
        return (level.against(a, x) if known is None else known)[at]

    def next_row(row: np.ndarray, x: int) -> np.ndarray:
        own = gain(x)
        if own is None:
            return row
        out = row.copy()
        np.maximum(row[1:], row[:-1] + own, out=out[1:])
        return np.maximum.accumulate(out)

    every = max(1, math.isqrt(len(xs)))
    row = np.zeros(len(ys) + 1, dtype=np.int64)
    held = []
    for i, x in enumerate(xs):
        if i % every == 0:
            held.append(row)
        row = next_row(row, x)
    total, pairs, j = int(row[-1]), [], len(ys)
    for k in range(len(held) - 1, -1, -1):
        table = [held[k]]
        for x in xs[k * every : (k + 1) * every]:
            table.append(next_row(table[-1], x))
        i = len(table) - 1
        while i and j:
            # as far left as the value stays, but up before left
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((xs[k * every + i], ys[j]))
    return total, pairs


def match(a: Tree, b: Tree) -> dict[int, int]:
    """Simple tree matching: the largest order-keeping map of nodes of ``a`` to nodes of ``b`` with equal labels and matched parents.

    Where two nodes have more than ``MOST_PAIRS`` pairs of children, the table
    of their children is filled row by row with arrays; the map is the same.
    """
    scores: dict[tuple[int, int], tuple[int, list[tuple[int, int]]]] = {}

    def middle(x: int, y: int) -> tuple[list[tuple[int, int]], list[int], list[int]]:
        """Pairs of equal subtrees at either end, and the children between them."""
        xs, ys = a.children[x], b.children[y]
        short = min(len(xs), len(ys))
        head = 0
        while head < short and a.shape[xs[head]] == b.shape[ys[head]]:
            head += 1
        tail = 0
        while tail < short - head and a.shape[xs[-1 - tail]] == b.shape[ys[-1 - tail]]:
            tail += 1
        pairs = list(zip(xs[:head], ys[:head])) + (list(zip(xs[-tail:], ys[-tail:])) if tail else [])
        return pairs, xs[head : len(xs) - tail], ys[head : len(ys) - tail]

    def solved(pairs: list, mx: list[int], my: list[int], open_: list[tuple[int, int]]) -> tuple[int, list[tuple[int, int]]]:
        total = 1 + sum(a.size[p] for p, _ in pairs)
        if not open_:
            return total, pairs
        table = [[0] * (len(my) + 1)]
        for p in mx:
            above, row = table[-1], [0]
            for j, q in enumerate(my):
                best = max(above[j + 1], row[j])
                if a.labels[p] == b.labels[q]:
                    best = max(best, above[j] + scores[p, q][0])
                row.append(best)
            table.append(row)
        i, j = len(mx), len(my)
        total += table[i][j]
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                pairs.append((mx[i], my[j]))
        return total, pairs

    parts: dict[tuple[int, int], tuple] = {}

    def score(x: int, y: int) -> None:
        todo = [(x, y)]
        while todo:
            x, y = todo[-1]
            if (x, y) in scores:
                todo.pop()
            elif a.shape[x] == b.shape[y]:
                scores[x, y] = a.size[x], list(zip(a.children[x], b.children[y]))
            elif (x, y) in parts:
                scores[x, y] = solved(*parts.pop((x, y)))
            else:
                pairs, mx, my = middle(x, y)
                if len(mx) * len(my) > MOST_PAIRS:
                    total, between = _matched_lists(a, b, mx, my)
                    scores[x, y] = 1 + sum(a.size[p] for p, _ in pairs) + total, pairs + between
                else:
                    open_ = [(p, q) for p in mx for q in my if a.labels[p] == b.labels[q]]
                    parts[x, y] = pairs, mx, my, open_
                    todo += [pair for pair in open_ if pair not in scores]

    if a.labels[0] != b.labels[0]:
        return {}
    found: dict[int, int] = {}
    todo = [(0, 0)]
    while todo:
        x, y = todo.pop()
        found[x] = y
        if a.shape[x] == b.shape[y]:
            todo += zip(a.children[x], b.children[y])
        else:
            score(x, y)  # of long lists' children only those that were paired
            todo += scores[x, y][1]
    return found


def align(page: Tree, reference: Tree) -> dict[int, int]:
    """The match, if enough of the smaller tree takes part in it."""
    found = match(page, reference)
    return found if len(found) >= ALIGNED * min(len(page.labels), len(reference.labels)) else {}


#: In the place of a layout: all pages of the host.
WHOLE_HOST = 0
LONGS, INTS = T.ArrayType(T.LongType()), T.ArrayType(T.IntegerType())


def _host(url) -> F.Column:
    return F.lower(F.regexp_extract(url, r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))


#: Places of texts in a node.
_PLACES = 1 << 32
PARSED = T.StructType([
    T.StructField("_host", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("_layout", "_page")),
    T.StructField("_labels", LONGS), T.StructField("_parents", INTS), *(T.StructField(n, LONGS) for n in ("_slots", "_texts")),
    T.StructField("_blocks", T.ArrayType(T.StringType())),
])


def parsed(pages: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep``, and what the one parse of a page yields.

    That is its host and layout, ``_page`` (a name of its texts), labels and
    parents of its tree, and of each text that may be content its node and place
    in it, its name and itself.
    """
    wide = pages.withColumn("_host", _host(F.col("url")))
    longs, ints = pa.list_(pa.int64()), pa.list_(pa.int32())
    kinds = [pa.int64(), pa.int64(), longs, ints, longs, longs, pa.list_(pa.string())]
    schema = T.StructType([*(wide.schema[c] for c in keep), *PARSED.fields])

    def run(batches):
        for batch in batches:
            rows = []
            for source in batch.column("html"):
                page = Page(source.as_py() or "")
                tree, place = tree_of(page)
                blocks = page.content()
                texts = [_hash(b.text) for b in blocks]
                slots = [place[page.element(b.node)] * _PLACES + b.place for b in blocks]
                rows.append((layout_of(page), hash(tuple(texts)) & (2**63 - 1), tree.labels, tree.parents, slots, texts, [b.text for b in blocks]))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), batch.column("_host"), *columns], names=schema.names)

    return wide.mapInArrow(run, schema)


#: The slot of a row that says only that a page was aligned.
_PAGE = -1


def induce(read: DataFrame) -> DataFrame:
    """host, layout, and wrappers of parsed pages: labels and parents of a reference page, slots and texts of the template that goes with it.

    A page has the wrapper of its layout and the one of its whole host, as far
    as there are some; only layouts that have one are listed.
    """
    known = read.filter("_host <> ''").select(*(F.col(f"_{c}").alias(c) for c in ("host", "layout", "page", "labels", "parents", "slots", "texts")))
    layouts = known.select("host", "layout").distinct()
    grouped = known.withColumn("layout", F.explode(F.array(F.lit(WHOLE_HOST).cast("bigint"), "layout")))
    key = ["host", "layout"]
    distinct = grouped.dropDuplicates([*key, "page"])
    many = distinct.groupBy(*key).agg(F.count("*").alias("pages"), F.min("page").alias("page")).filter(F.col("pages") >= TEMPLATE_PAGES).drop("pages")
    references = grouped.join(many, [*key, "page"]).groupBy(*key).agg(F.first("labels").alias("ref_labels"), F.first("parents").alias("ref_parents"))
    references = cut(references, "references")
    slot = T.StructType([T.StructField("host", T.StringType()), *(T.StructField(n, T.LongType()) for n in ("layout", "slot", "text"))])

    def run(batches):
        kept: dict[tuple, Tree] = {}
        for batch in batches:
            out: list[tuple] = []
            for row in batch.to_pylist():
                own = row["host"], row["layout"]
                if own not in kept:
                    kept.clear() if len(kept) > 1000 else None
                    kept[own] = Tree(row["ref_labels"], row["ref_parents"])
                found = align(Tree(row["labels"], row["parents"]), kept[own])
                if found:
                    out.append((*own, _PAGE, 0))
                for s, t in zip(row["slots"], row["texts"]):
                    if s // _PLACES in found:
                        out.append((*own, found[s // _PLACES] * _PLACES + s % _PLACES, t))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate([pa.string(), *[pa.int64()] * 3])], slot.names)

    seen = distinct.join(references, key).select(*key, "labels", "parents", "slots", "texts", "ref_labels", "ref_parents").mapInArrow(run, slot)
    # A template text stands on so many pages at least, and so do the pages that are aligned.
    counts = cut(seen.groupBy(*key, "slot", "text").agg(F.count("*").alias("n")).filter(F.col("n") >= TEMPLATE_PAGES), "counts")
    aligned = counts.filter(F.col("slot") == _PAGE).select(*key, F.col("n").alias("pages"))
    fixed = counts.filter(F.col("slot") != _PAGE).join(aligned, key).filter(F.col("n") >= TEMPLATE_SHARE * F.col("pages"))
    fixed = fixed.groupBy(*key).agg(F.collect_list("slot").alias("slots"), F.collect_list("text").alias("texts"))
    made = fixed.join(references, key).select(*key, F.struct(F.col("ref_labels").alias("labels"), F.col("ref_parents").alias("parents"), "slots", "texts").alias("wrapper"))
    made = cut(made, "wrappers")
    of_host = made.filter(F.col("layout") == WHOLE_HOST).select("host", F.col("wrapper").alias("of_host"))
    both = layouts.join(made, key, "left").join(of_host, "host", "left").select(*key, F.array_compact(F.array("wrapper", "of_host")).alias("wrappers"))
    return cut(both.filter(F.size("wrappers") > 0), "layouts")


def is_content(labels: list[int], parents: list[int], slots: list[int], texts: list[int], wrappers: list[tuple]) -> list[bool]:
    """Which texts of a page are no template text of its layout or host."""
    tree = Tree(labels, parents)
    found = [(align(tree, reference), template) for reference, template in wrappers]
    return [
        not any(s // _PLACES in nodes and (nodes[s // _PLACES] * _PLACES + s % _PLACES, t) in template for nodes, template in found)
        for s, t in zip(slots, texts)
    ]


def _read(given: list[dict]) -> list[tuple]:
    """Reference trees and templates; templates of the same reference are one."""
    templates: dict[tuple, set] = {}
    for w in given:
        templates.setdefault((tuple(w["labels"]), tuple(w["parents"])), set()).update(zip(w["slots"], w["texts"]))
    return [(Tree(list(labels), list(parents)), template) for (labels, parents), template in templates.items()]


def extract(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Add ``text``, the main text of every page, to its rows.

    A null html has an empty text; a page without a host, or of a host and
    layout without a template, is cleaned by elements and names alone.  A column
    of ``pages`` named ``text`` is replaced; ``keep`` names the columns to
    return, all by default.
    """
    keep = [c for c in keep or pages.columns if c.lower() != "text"]
    pages, renamed = set_aside(pages, "_key", "_key_layout", "_wrapper", *PARSED.names)
    own = [renamed[c] for c in keep]
    read = cut(parsed(pages, own), "parsed")
    wrappers = induce(read).select(F.col("host").alias("_key"), F.col("layout").alias("_key_layout"), F.col("wrappers").alias("_wrapper"))
    joined = read.join(wrappers, (F.col("_host") == F.col("_key")) & (F.col("_layout") == F.col("_key_layout")), "left").drop("_key", "_key_layout", "_page")

    def run(batches):
        kept: dict[tuple, list[tuple]] = {}
        for batch in batches:
            texts = []
            for host, layout, given, *columns, blocks in zip(*(batch.column(c) for c in ("_host", "_layout", "_wrapper", "_labels", "_parents", "_slots", "_texts", "_blocks"))):
                blocks = blocks.as_py()
                if given.is_valid and blocks:
                    key = host.as_py(), layout.as_py()
                    if key not in kept:
                        kept.clear() if len(kept) > 1000 else None
                        kept[key] = _read(given.as_py())
                    wanted = is_content(*(c.as_py() for c in columns), kept[key])
                    blocks = [b for b, stays in zip(blocks, wanted) if stays]
                texts.append(" ".join(blocks))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in own), pa.array(texts, pa.string())], [*own, "text"])

    found = joined.mapInArrow(run, T.StructType([*(joined.schema[c] for c in own), T.StructField("text", T.StringType())]))
    return found.withColumnsRenamed({n: c for c, n in renamed.items() if c != n and n in own})


def digest(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(pages.select("page_id", "url", "html"), ["page_id", "url"]).select("page_id", "url", "text", F.length("text").cast("bigint").alias("n_chars"))
