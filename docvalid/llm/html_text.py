"""Main text of web pages by site style trees.

All pages of a host are merged into one tree.  Its nodes are paths of elements (with
their class and id), each known by a digest of its parent's and its own label.  A
content node holds the texts that pages show directly in the elements of a path; a
presentation node is the sequence of block elements that they show in it.  A node's
importance is the entropy of what its pages have there, as a share of the greatest
that so many pages could have: near 0 for the same few texts or forms everywhere, near
1 for what differs from page to page.  A branch, a content node below its parent's
presentation, has the importance

    prior * (GAMMA * content + (1 - GAMMA) * presentation of the parent).

All blocks that are displayed go through the tree; names only lower an importance:

- strong ones (menu, footer, aside and form elements, such roles, and classes of adverts,
  comments and recommendations, which differ from page to page by nature) multiply it
  by the share of the page's text that the named element holds;
- weak ones (classes of layout parts, and a place outside the page's article or main
  element) by WEAK, or that share if it is more.

Where a host has too few pages of a branch, the shares alone decide.  A class reaches
into no article or main element, save those that name comments, adverts and
recommendations, which reach into articles.  A page's text are the blocks whose
branches are important.

A page is read once, in one pass forward whose time and memory are linear in its size;
what it holds is written, and the rest are DataFrame functions.
"""

from __future__ import annotations

import html as entities
import re
import zlib
from collections.abc import Iterator
from hashlib import blake2b

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import plain, table, tidy, written

#: A branch below this importance is removed where the host has so many pages with it.
LOW, PAGES = 0.5, 8
#: What a weak name leaves of a branch's importance; the share of content in it.
WEAK, GAMMA = 0.6, 0.9
#: Rows of branches up to which they are broadcast (about 30 bytes each).
BROADCAST_ROWS = 100_000

NAME = re.compile(r"[a-zA-Z][^\s/>]*")
#: What can end a tag, or begin a quoted value in it.
NEXT = re.compile(r">|=\s*([\"'])")
ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))")
RAW = {"script", "style", "textarea", "title", "noscript", "template", "iframe", "svg", "math", "noembed", "xmp"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "meter", "nobr", "q", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr"}
HIDDEN = {"head", "button", "select", "dialog", "object", "canvas", "audio", "video"}
HIDES = re.compile(r"(?:^|\s)hidden(?:\s|=|$)")
NO_DISPLAY = re.compile(r"display\s*:\s*none")
NAMED = {"nav", "footer", "aside", "form", "menu", "fieldset"}
#: Classes of what differs from page to page and is still not the page's own text.
OTHERS_WORD = re.compile(r"(?:^|[\s_-])(?:ads?|advert\w*|comments?|replies|disqus|promo\w*|(?:related|recommended)[_-](?:posts?|articles?|stories|links?|content|items?)|sponsor\w*)(?:$|[\s_-])")
LAYOUT_WORD = re.compile(r"(?:^|[\s_-])(?:banners?|breadcrumbs?|cookies?|consent|gdpr|notices?|alerts?|popups?|modal|footer|menus?|nav|navbar|navigation|newsletter|subscribe|share|sharing|social|sidebar|side|widgets?|toolbar|login|signup|skip|masthead|header)(?:$|[\s_-])")
#: Classes that say what else the page has, or name a part of the text itself.
NEUTRAL_WORD = re.compile(r"(?:^|(?<=\s))\S*?(?:(?:(?<=[\s_-])|(?<!\S))(?:has|no|with|without)[_-]\S+|(?:(?<=[\s_-])|(?<!\S))(?:entry|post|article|content|story)[_-]+header(?!\S))")
NOISE_ROLE = {"navigation", "banner", "contentinfo", "complementary", "search", "form", "alert", "dialog", "menu", "menubar", "alertdialog"}
#: What a start tag ends: an open element of these names, up to the nearest of the scope.
ENDS = {"li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"})}


class Element:
    """An open element; strong and weak are the nearest elements around or at it whose names say something."""

    __slots__ = ("name", "label", "node", "parent", "noise", "main", "strong", "weak", "depth", "closed", "holder", "shape", "children")

    def __init__(self, name: str, label: str, node: int, parent: Element | None, noise: bool, main: bool, strong: int | None, weak: int | None) -> None:
        self.name, self.label, self.node, self.parent = name, label, node, parent
        self.noise, self.main, self.strong, self.weak = noise, main, strong, weak
        block = name not in INLINE
        self.depth = (parent.depth if parent else 0) + block  #: of block elements
        self.holder: Element = self if block or parent is None else parent.holder
        self.closed, self.shape, self.children = False, 0, 0


class Block:
    __slots__ = ("node", "parent", "label", "noise", "main", "strong", "weak", "parts")

    def __init__(self, of: Element, top: Element) -> None:
        outer = of.parent.holder if of.parent else of
        self.node, self.parent, self.label = of.node, outer.node, of.label
        self.noise, self.main, self.strong, self.weak, self.parts = top.noise, top.main, top.strong, top.weak, []

    def text(self) -> str:
        return " ".join(entities.unescape("".join(self.parts)).split())


def node_of(parent: int, label: str) -> int:
    return int.from_bytes(blake2b(b"%d/%s" % (parent, label.encode("utf-8", "surrogatepass")), digest_size=8).digest(), "little", signed=True)


def _element(parent: Element, name: str, attributes: str) -> Element:
    found = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)} if "=" in attributes else {}
    said = f"{found.get('class', '')} {found.get('id', '')}".lower().strip()
    style = ".".join(sorted(set(said.split())))
    role = found.get("role", "").lower()
    opens = name in ("article", "main") or role == "main"
    noise = parent.noise or name in HIDDEN or found.get("aria-hidden") == "true" or HIDES.search(attributes) is not None
    noise = noise or NO_DISPLAY.search(found.get("style", "")) is not None
    plainly = "" if name in ("article", "main", "body", "html") else NEUTRAL_WORD.sub(" ", said)
    element = name in NAMED or (name == "header" and not parent.main) or role in NOISE_ROLE
    others, layout = OTHERS_WORD.search(plainly) is not None, LAYOUT_WORD.search(plainly) is not None
    label = name + (f".{style}" if style else "") + ("!" if element or others else "?" if layout else "") + ("=" if role == "main" else "")
    node = node_of(parent.node, label)
    strong = parent.strong if not opens or name == "article" else None
    weak = None if opens else parent.weak
    if element or others:
        strong = node
    elif layout:
        weak = node
    return Element(name, label, node, parent, noise, bool(parent.main or opens), strong, weak)


def _tag_end(page: str, at: int, unclosed: set[str]) -> int:
    """Where the tag that goes on at ``at`` has its ">", quoted values aside, or -1; a quote that is never closed is none."""
    while (m := NEXT.search(page, at)) is not None:
        if m[1] is None:
            return m.start()
        close = -1 if m[1] in unclosed else page.find(m[1], m.end())
        if close < 0:
            unclosed.add(m[1])
            return page.find(">", m.end())
        at = close + 1
    return -1


class Page:
    """A page's blocks, runs of text that no block element interrupts, in order, and its presentation nodes."""

    def __init__(self, page: str) -> None:
        root = Element("", "", 0, None, False, False, None, None)
        self.stack = [root]
        self.open: dict[str, list[Element]] = {}
        self.blocks: list[Block] = []
        self.shapes: dict[int, tuple[int, str, int]] = {}  #: by node: its parent, label and form
        self.outer: dict[int, int | None] = {}  #: of a node whose name says something, the next such around it, of the same kind
        self.now: Block | None = None
        self._read(page)
        while len(self.stack) > 1:
            self._pop()

    def _add(self, text: str) -> None:
        if self.now is None and not text.strip():
            return
        top = self.stack[-1]
        if self.now is None or (top.noise, top.strong, top.weak) != (self.now.noise, self.now.strong, self.now.weak) and text.strip():
            holder = top.holder
            same = (top.noise, top.strong, top.weak) == (holder.noise, holder.strong, holder.weak)
            self.now = Block(holder if same else top, top)
            self.blocks.append(self.now)
        self.now.parts.append(text)

    def _push(self, e: Element) -> None:
        parent = self.stack[-1]
        for mine, above in ((e.strong, parent.strong), (e.weak, parent.weak)):
            if mine is not None and mine != above:
                self.outer.setdefault(mine, above)
        if e.holder is e and not e.noise:
            around = parent.holder
            around.shape = zlib.crc32(e.label.encode("utf-8", "surrogatepass"), around.shape)
            around.children += 1
        self.stack.append(e)
        self.open.setdefault(e.name, []).append(e)

    def _pop(self) -> Element:
        e = self.stack.pop()
        if not e.closed:
            self.open[e.name].pop()
        if e.children and e.parent is not None:
            before = self.shapes.get(e.node, (0, "", 0))[2]
            self.shapes[e.node] = (e.parent.holder.node, e.label, zlib.crc32(b"%d" % e.shape, before))
        return e

    def _close(self, name: str) -> None:
        open_ = self.open.get(name)
        if not open_:
            if name not in INLINE:
                self.now = None
            return
        if name not in INLINE:
            self.now = None
            while self._pop().name != name:
                pass
        elif open_[-1].depth == self.stack[-1].depth:  # an inline end does not end a block element
            open_.pop().closed = True
            while self.stack[-1].closed:
                self._pop()

    def _start(self, name: str, attributes: str) -> None:
        stack, open_ = self.stack, self.open
        if name not in INLINE:
            self.now = None
            ends, scope = ENDS.get(name, (set(), set()))
            if any(open_.get(x) for x in ends):
                k = len(stack) - 1
                while k > 0 and stack[k].name not in scope and (stack[k].name not in ends or stack[k].closed):
                    k -= 1
                if k > 0 and stack[k].name in ends:
                    while len(stack) > k:
                        self._pop()
            # a block element ends an open paragraph and what is open in it
            if (paragraphs := open_.get("p")) and paragraphs[-1].depth == stack[-1].depth:
                while self._pop().name != "p":
                    pass
        self._push(_element(stack[-1], name, attributes))

    def _read(self, page: str) -> None:
        at, end, unclosed = 0, len(page), set()
        while at < end:
            m = page.find("<", at)
            if m < 0:
                self._add(page[at:])
                return
            if m > at:
                self._add(page[at:m])
            follows = page[m + 1 : m + 2]
            closing = follows == "/"
            name = NAME.match(page, m + 1 + closing)
            if name is None:
                if page.startswith("<!--", m):
                    at = page.find("-->", m + 4) + 3
                elif follows in ("!", "?", "/"):
                    at = page.find(">", m) + 1
                else:  # no tag
                    self._add("<")
                    at = m + 1
                    continue
                if at <= m:  # open up to the end
                    return
                continue
            to = _tag_end(page, name.end(), unclosed)
            if to < 0:
                return
            tag, attributes, at = name[0].lower(), page[name.end() : to], to + 1
            if tag == "br":
                self._add(" ")
            elif closing:
                if tag not in RAW and tag not in VOID:
                    self._close(tag)
            elif tag in RAW:
                if not attributes.rstrip().endswith("/"):
                    close = re.compile(rf"</{re.escape(tag)}[\s/>]", re.I).search(page, at)
                    at = page.find(">", close.end() - 1) + 1 if close else end
                    if not at:
                        return
            elif tag in VOID:
                if tag not in INLINE:
                    self.now = None
            else:
                self._start(tag, attributes)

    def branches(self) -> tuple[list[tuple[int, str, float, bool]], list[tuple[int, int, str, int, float, float]]]:
        """The blocks that show text (node, text, its share where names alone decide, in an article or main element or not), and for each of their nodes: parent, label, digest of its texts, what names leave of its importance, and that share."""
        shown = [(b, t) for b in self.blocks if not b.noise and (t := b.text())]
        total = sum(len(t) for _, t in shown)
        under = dict.fromkeys(self.outer, 0)
        for b, t in shown:
            for name in (b.strong, b.weak):
                if name is not None:
                    under[name] += len(t)
        for name, around in reversed(self.outer.items()):  # inner ones come after those around them
            if around is not None:
                under[around] += under[name]
        share = lambda name: 1.0 if name is None else under[name] / total
        # alone, a layout's name takes nothing from an article
        alone = {b.node: min(share(b.strong), 1.0 if b.main else share(b.weak)) for b, _ in shown}
        prior = {b.node: min(share(b.strong), max(share(b.weak), WEAK)) for b, _ in shown}
        main = {b.node: b.main for b, _ in shown}
        # inside and outside of article or main elements, of what no name removes
        sizes = {inside: sum(len(t) for b, t in shown if main[b.node] is inside and alone[b.node] >= LOW) for inside in (True, False)}
        outside = sizes[False] / max(1, sizes[True] + sizes[False])
        if sizes[True]:
            for node, inside in main.items():
                if not inside:
                    prior[node], alone[node] = min(prior[node], max(outside, WEAK)), min(alone[node], outside)
        nodes: dict[int, tuple[int, str, int]] = {}
        for b, t in shown:
            nodes[b.node] = (b.parent, b.label, zlib.crc32(t.encode("utf-8", "surrogatepass"), nodes.get(b.node, (0, "", 0))[2]))
        return [(b.node, t, alone[b.node], main[b.node]) for b, t in shown], [(n, *x, prior[n], alone[n]) for n, x in nodes.items()]


def host_of(url: str | None) -> str:
    m = re.match(r"\s*(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?//(?:[^/?#@]*@)?([^/?#:]*)", url or "")
    return m[1].lower() if m else ""


_BLOCK = pa.struct([("node", pa.int64()), ("text", pa.string()), ("alone", pa.float64()), ("main", pa.bool_())])
_LEAF = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("content", pa.int64()), ("prior", pa.float64()), ("alone", pa.float64())])
_INNER = pa.struct([("node", pa.int64()), ("parent", pa.int64()), ("label", pa.string()), ("shape", pa.int64())])
READ = "page_id long, url string, host string, blocks array<struct<node:bigint,text:string,alone:double,main:boolean>>, leaves array<struct<node:bigint,parent:bigint,label:string,content:bigint,prior:double,alone:double>>, inner array<struct<node:bigint,parent:bigint,label:string,shape:bigint>>"


def _lists(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    ends, flat = [0], []
    for r in rows:
        flat += r
        ends.append(len(flat))
    columns = [pa.array([x[k] for x in flat], f.type) for k, f in enumerate(kind)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(columns, fields=list(kind)))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for first in range(0, batch.num_rows, 200):
            part = batch.slice(first, 200)
            blocks, leaves, inner = [], [], []
            for text in part.column(2):
                page = Page(text.as_py() or "")
                shown, nodes = page.branches()
                blocks.append(shown), leaves.append(nodes)
                inner.append([(n, *x) for n, x in page.shapes.items()])
            hosts = pa.array([host_of(u) for u in part.column(1).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), hosts, _lists(blocks, _BLOCK), _lists(leaves, _LEAF), _lists(inner, _INNER)], ["page_id", "url", "host", "blocks", "leaves", "inner"])


def read_pages(pages: DataFrame) -> DataFrame:
    """READ of a table (page_id, url, html): what each page shows, and its nodes."""
    return pages.select("page_id", "url", "html").mapInArrow(tidy(_read), READ)


def style_tree(read: DataFrame) -> DataFrame:
    """(host, node, parent, label, pages, content, presentation, prior, importance, least, most) of every branch of the pages that ``read_pages`` read.

    content: the entropy of the texts over the pages that have the branch, presentation
    that of its parent's forms, both by the logarithm of their number and 1 for one
    page.  prior: what names leave of it on average; least and most: the bounds of its
    share by names alone.  Texts and forms are counted before they meet by host and
    node, so that no host's pages gather.
    """
    entropy = lambda n: F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)
    share = lambda h: F.when(F.col("pages") > 1, F.least(F.lit(1.0), h / F.log(F.col("pages").cast("double")))).otherwise(F.lit(1.0))
    each = read.select("host", F.explode("leaves").alias("x")).select("host", "x.*")
    texts = each.groupBy("host", "node", "content").agg(F.count("*").cast("double").alias("n"), F.min("parent").alias("parent"), F.min("label").alias("label"), F.sum("prior").alias("prior"), F.min("alone").alias("least"), F.max("alone").alias("most"))
    leaves = texts.groupBy("host", "node").agg(F.sum("n").cast("long").alias("pages"), F.min("parent").alias("parent"), F.min("label").alias("label"), entropy(F.col("n")).alias("h"), (F.sum("prior") / F.sum("n")).alias("prior"), F.min("least").alias("least"), F.max("most").alias("most"))
    leaves = leaves.withColumn("content", share(F.col("h"))).drop("h")
    forms = read.select("host", F.explode("inner").alias("x")).select("host", "x.node", "x.shape").groupBy("host", "node", "shape").agg(F.count("*").cast("double").alias("n"))
    inner = forms.groupBy("host", F.col("node").alias("parent")).agg(F.sum("n").cast("long").alias("pages"), entropy(F.col("n")).alias("h")).select("host", "parent", share(F.col("h")).alias("presentation"))
    tree = leaves.join(inner, ["host", "parent"], "left").fillna(0.0, ["presentation"])
    importance = F.col("prior") * (GAMMA * F.col("content") + (1 - GAMMA) * F.col("presentation"))
    return tree.select("host", "node", "parent", "label", "pages", "content", "presentation", "prior", importance.alias("importance"), "least", "most")


def main_text(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", low: float = LOW, least: int = PAGES) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``.

    A page gives the blocks of its branches of importance ``low`` or more; where fewer
    than ``least`` pages of its host have a branch, a name or a place outside the
    article or main element removes it if it holds less than ``low`` of the text.  A
    page with such an element of which the tree leaves nothing keeps it.  Pages without
    a host, or with a null url, are merged as one host.  A null or empty html gives an
    empty text, one without tags itself; a tag or comment that the page's end cuts off
    is none of its text.  Repeated rows count each; an empty table gives an empty
    result; other columns are left out.
    """
    pages = plain(pages, page_id=pages[f"`{id_col}`"].cast("long"), url=pages[f"`{url_col}`"].cast("string"), html=pages[f"`{html_col}`"].cast("string"))
    read = written(read_pages(pages), "pages")
    keep = F.col("importance") >= low
    # only where the tree says other than the names alone could
    tree = style_tree(read).where((F.col("pages") >= least) & ((~keep & (F.col("most") >= low)) | (keep & (F.col("least") < low)))).select("host", "node", keep.alias("keep"))
    decided = written(tree, "decided-branches")
    few = decided.count() <= BROADCAST_ROWS
    per = decided.groupBy("host").agg(F.map_from_entries(F.collect_list(F.struct("node", "keep"))).alias("said"))
    joined = read.select("page_id", "url", "host", "blocks").join(F.broadcast(per) if few else per, "host", "left")
    named = lambda b: b["alone"] >= low
    kept = F.filter("blocks", lambda b: F.coalesce(F.element_at("said", b["node"]), named(b)))
    # the tree leaves nothing of an article whose every page is alike: names alone decide
    kept = F.when(F.size(kept) > 0, kept).otherwise(F.filter("blocks", lambda b: b["main"] & named(b)))
    text = F.array_join(F.transform(kept, lambda b: b["text"]), "\n")
    return joined.select("page_id", "url", text.alias("text")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))
