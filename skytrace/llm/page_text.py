"""Main text of web pages by wrapper induction (operator 2).

A page becomes a tree of blocks with its text runs as leaves. Each host has one reference page, the
first by hash. Simple tree matching aligns every page of the host with it: ordered, label by label, the
largest number of matching nodes. A text slot of the reference whose aligned text is the same on
``CONSTANT`` of at least ``PAGES`` other articles is template; varying slots and what the reference lacks
are content. Of that, the parts that are no article by their kind go: menus, headers, footers,
sidebars, notices, adverts, forms, scripts, styles and reader comments, by tag, role and name. If the
page marks an article or main part with text, only that counts.

Each page is parsed and aligned once; its blocks are stored with their slots. Pages with the
same content blocks are one article, whatever their menus and adverts: each article counts once, and the
reference's own doesn't count as evidence. The references, a page per host, are broadcast if they measure up to ``BROADCAST`` bytes; beyond, the pages meet
them in an equi-join that Spark splits where a host is hot. No task sees a host whole.
"""

from __future__ import annotations

import re
from collections import Counter
from hashlib import blake2b
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skytrace.llm.tasks import stored

CONSTANT, PAGES = 0.9, 5
BROADCAST = 32 << 20
DEEPEST = 200  # blocks nested deeper become siblings there
BLOCKS = set(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "frameset h1 h2 h3 h4 h5 h6 head header hgroup html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead title tr ul".split()
)
HIDDEN = set(
    "aside button canvas datalist dialog embed fieldset footer form frameset head iframe menu nav noscript object optgroup option "
    "script select style svg template textarea title".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ROLES = set("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments consent cookie cookies "
    "disqus footer menu modal nav navbar navigation newsletter notice notices pager pagination popup promo related respond share "
    "sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
)
ENDS = {  # a start of the first closes an open one of the second, up to one of the third
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
}


class Node:
    __slots__ = ("hidden", "kids", "label", "parts", "shape", "size", "tag", "text")

    def __init__(self, tag: str, label: str, hidden: bool):
        self.tag, self.label, self.hidden = tag, label, hidden
        self.kids: list[Node] = []
        self.parts: list[str] = []  # of a text run
        self.size = self.shape = 0
        self.text = ""


class _Builder(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = Node("#root", "#root", False)
        self.open = [self.root]
        self.over = Counter()  # started at the depth limit, not in ``open``, end still to come

    def _hides(self, tag: str, attrs: dict) -> bool:
        if tag in HIDDEN:
            return True
        inside = any(n.tag in ("article", "main") for n in self.open)
        if tag == "header":
            return not inside
        if tag in ("html", "body", "article", "main"):
            return False
        if attrs.get("role", "").strip().lower() in ROLES or "hidden" in attrs or attrs.get("aria-hidden") == "true":
            return True
        names = set(re.split(r"[^a-z]+", f"{attrs.get('class', '')} {attrs.get('id', '')}".lower()))
        return bool(names & NAMES) or (not inside and "header" in names)

    def _close(self, tags: set, until: set) -> None:
        for i in range(len(self.open) - 1, 0, -1):
            if self.open[i].tag in tags:
                del self.open[i:]
                return
            if self.open[i].tag in until:
                return

    def handle_starttag(self, tag, attrs):
        if tag in VOID:
            self.handle_data(" ")
            return
        if len(self.open) > DEEPEST and self.open[-1].hidden:  # all that is inside stays hidden
            self.over[tag] += 1
            return
        named = {k: v or "" for k, v in attrs}
        hidden = self._hides(tag, named)
        if tag not in BLOCKS and not hidden:
            return
        if tag in BLOCKS:
            self._close({"p"}, {"td", "th", "table", "button", "object"})
        if tag in ENDS:
            self._close(*ENDS[tag])
        node = Node(tag, f"{tag}.{named.get('class', '')}", hidden)
        if len(self.open) > DEEPEST:
            self.over[self.open.pop().tag] += 1
        self.open[-1].kids.append(node)
        self.open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self.over[tag] > 0:
            self.over[tag] -= 1
            return
        self._close({tag}, set() if tag in BLOCKS else BLOCKS)
        if len(self.open) <= DEEPEST:
            self.over.clear()

    def handle_data(self, data):
        kids = self.open[-1].kids
        if not kids or kids[-1].tag != "#text":
            if not data.strip():
                return
            kids.append(Node("#text", "#text", False))
        kids[-1].parts.append(data)


def parse(html: str) -> Node:
    """The page's block tree with ``size`` and ``shape`` (equal for equal structure) of every node."""
    builder = _Builder()
    builder.feed(html)
    builder.close()
    order = [builder.root]
    for n in order:
        order.extend(n.kids)
    for n in reversed(order):
        if n.parts:
            n.text = " ".join("".join(n.parts).split())
        n.size = 1 + sum(k.size for k in n.kids)
        n.shape = hash((n.label, *(k.shape for k in n.kids)))
    return builder.root


def _ends_alike(a: list[Node], b: list[Node]) -> tuple[int, int]:
    """How many kids at the beginning and at the end match as they stand: equal shapes, so no other choice is better."""
    i, most = 0, min(len(a), len(b))
    while i < most and a[i].shape == b[i].shape:
        i += 1
    j = 0
    while j < most - i and a[-1 - j].shape == b[-1 - j].shape:
        j += 1
    return i, j


def _table(a: list[Node], b: list[Node], memo: dict) -> tuple[np.ndarray, np.ndarray]:
    weights = np.array([[_matched(x, y, memo) for y in b] for x in a], np.int32)
    best = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i, row in enumerate(weights, 1):
        best[i, 1:] = np.maximum.accumulate(np.maximum(best[i - 1, 1:], best[i - 1, :-1] + row))
    return best, weights


def _matched(a: Node, b: Node, memo: dict) -> int:
    """Nodes in the largest matching of two trees."""
    if a.label != b.label:
        return 0
    if a.shape == b.shape:
        return a.size
    if not a.kids or not b.kids:
        return 1
    key = (a.shape, b.shape)
    if key not in memo:
        i, j = _ends_alike(a.kids, b.kids)
        total = 1 + sum(k.size for k in a.kids[:i]) + sum(k.size for k in a.kids[len(a.kids) - j :])
        x, y = a.kids[i : len(a.kids) - j], b.kids[i : len(b.kids) - j]
        memo[key] = total + (int(_table(x, y, memo)[0][-1, -1]) if x and y else 0)
    return memo[key]


def align(reference: Node, page: Node) -> list[tuple[Node, Node]]:
    """Pairs of matched nodes."""
    memo: dict = {}
    pairs = [(reference, page)]
    for a, b in pairs:
        i, j = _ends_alike(a.kids, b.kids)
        m, n = len(a.kids) - j, len(b.kids) - j
        pairs.extend(zip(a.kids[:i] + a.kids[m:], b.kids[:i] + b.kids[n:], strict=True))
        if i < m and i < n:
            x, y = a.kids[i:m], b.kids[i:n]
            best, weights = _table(x, y, memo)
            p, q = len(x), len(y)
            while p and q:
                if best[p, q] == best[p - 1, q]:
                    p -= 1
                elif best[p, q] == best[p, q - 1]:
                    q -= 1
                else:
                    p, q = p - 1, q - 1
                    pairs.append((x[p], y[q]))
    return pairs


def text_slots(root: Node) -> dict[int, int]:
    """Number of each text run of a tree, by identity, in page order."""
    found, stack = {}, [root]
    while stack:
        n = stack.pop()
        if n.tag == "#text":
            found[id(n)] = len(found)
        stack.extend(reversed(n.kids))
    return found


def content(root: Node) -> list[Node]:
    """Text runs that are content by their kind, in page order."""
    inside, outside = [], []
    stack = [(root, False)]
    while stack:
        n, article = stack.pop()
        if n.hidden:
            continue
        if n.tag == "#text" and n.text:
            outside.append(n)
            if article:
                inside.append(n)
        article = article or n.tag in ("article", "main")
        stack.extend((k, article) for k in reversed(n.kids))
    return inside or outside


class _References:
    """Parsed references of the hosts met last."""

    def __init__(self):
        self.held: dict[str, tuple[Node, dict[int, int], bytes]] = {}

    def get(self, host: str, html: str) -> tuple[Node, dict[int, int], bytes]:
        if host not in self.held:
            if len(self.held) >= 64:
                self.held.pop(next(iter(self.held)))
            root = parse(html)
            self.held[host] = root, text_slots(root), _article(content(root))
        return self.held[host]


def _article(blocks: list[Node]) -> bytes:
    return blake2b("\n".join(b.text for b in blocks).encode("utf-8", "surrogatepass"), digest_size=16).digest()


def _aligned(batches):
    """Content blocks of each page, each with the reference's slot it aligns with (-1: none) and whether the text is the same."""
    seen = _References()
    for batch in batches:
        out: list[tuple] = []
        for host, html, reference in zip(*(batch.column(c).to_pylist() for c in ("host", "html", "reference")), strict=True):
            page = parse(html or "")
            blocks = content(page)
            slots, article, copy = {}, _article(blocks), False
            if reference is not None:
                root, numbers, own = seen.get(host, reference)
                copy = article == own
                slots = {id(b): (numbers[id(a)], a.text == b.text) for a, b in align(root, page) if a.tag == "#text"}
            found = [slots.get(id(b), (-1, False)) for b in blocks]
            out.append(([b.text for b in blocks], [f[0] for f in found], [f[1] for f in found], article, copy))
        kinds = [pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.bool_()), pa.binary(), pa.bool_()]
        columns = [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)]
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "url", "host")), *columns], ["page_id", "url", "host", "blocks", "slots", "same", "article", "copy"])


def _small(df: DataFrame, size) -> DataFrame:
    """``df`` as a broadcast if its measured size is within ``BROADCAST`` bytes, else as it is."""
    return F.broadcast(df) if (df.agg(F.sum(size)).first()[0] or 0) <= BROADCAST else df


def main_text(pages: DataFrame) -> DataFrame:
    """``(page_id, url, text, n_chars)`` per row of ``pages(page_id, url, html, ...)``.

    Null or empty html has the empty text. A page whose url has no host is judged by itself, as is one on a
    host with few pages. Repeated rows are each returned; other columns are ignored; an empty table
    gives an empty result.
    """
    host = F.lower(F.regexp_extract(F.coalesce(F.col("url").cast("string"), F.lit("")), r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"), host.alias("host"))
    mark = F.xxhash64("page_id", "url", F.length("html"))
    usable = rows.where("host <> '' AND html <> ''")
    firsts = usable.groupBy("host").agg(F.min(F.struct(mark.alias("h"), "page_id")).alias("first"), F.count("*").alias("pages"))
    firsts = firsts.where(F.col("pages") > PAGES).select("host", F.col("first.h").alias("h"))
    refs = usable.withColumn("h", mark).join(firsts, ["host", "h"]).groupBy("host").agg(F.min("html").alias("reference"))
    refs = stored(refs, "references")
    joined = rows.join(_small(refs, F.octet_length("reference") + 64), "host", "left").select("page_id", "url", "host", "html", "reference")
    schema = "page_id long, url string, host string, blocks array<string>, slots array<int>, same array<boolean>, article binary, copy boolean"
    parsed = stored(joined.mapInArrow(_aligned, schema), "blocks", "zstd")
    articles = parsed.where("NOT copy").groupBy("host", "article").agg(F.min(F.struct("slots", "same")).alias("x"))
    articles = articles.select("host", "x.*")
    each = articles.select("host", F.explode(F.arrays_zip("slots", "same")).alias("x")).where("x.slots >= 0").select("host", "x.*")
    counts = each.groupBy("host", F.col("slots").alias("slot")).agg(F.count("*").alias("n"), F.sum(F.col("same").cast("long")).alias("same"))
    constant = counts.where((F.col("n") >= PAGES) & (F.col("same") >= CONSTANT * F.col("n")))
    wrappers = stored(constant.groupBy("host").agg(F.collect_list("slot").alias("template")), "wrappers")
    named = parsed.join(_small(wrappers, 4 * F.size("template") + 64), "host", "left")
    standing = lambda x: x["same"] & F.array_contains(F.coalesce("template", F.array().cast("array<int>")), x["slots"])
    kept = F.filter(F.arrays_zip("blocks", "slots", "same"), lambda x: ~standing(x))
    text = F.array_join(F.transform(kept, lambda x: x["blocks"]), "\n")
    return named.select("page_id", "url", text.alias("text")).select("*", F.length("text").cast("long").alias("n_chars"))
