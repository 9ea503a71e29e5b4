"""Main text of web pages by composite text density.

A page becomes a tree of elements. An element's density is its characters per tag, adjusted for the share of characters
and tags that are links; its sum is the sum of its children's densities. The element with the largest sum holds the text;
the least density on its way up to the body is the threshold at which other parts of the page count as text too.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import batch, require

#: HTML's elements without content, those whose content is no markup, and those that start a block.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript template textarea title iframe svg math select object".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
#: Elements that never hold an article's text, and words in class, id or role that mark such parts.
NOISE = frozenset("aside button dialog footer form head header input label menu nav optgroup option".split()) | RAW
HARD_TAGS = RAW | {"button", "head", "input", "optgroup", "option"}
HARD, BY_TAG, BY_WORD = 1, 2, 3
MARKS = frozenset(
    "ad ads adv advert advertisement adverts alert banner breadcrumb breadcrumbs button comment comments complementary contentinfo cookie cookies disqus "
    "footer header masthead menu modal nav navbar navigation newsletter notice popup promo promoted promotion related replies "
    "search share sharing sidebar skip social sponsor sponsored subscribe toolbar widget".split()
)
#: Words that beside one of those don't change what a name means; with any other word (`share-price`) the name is no mark.
LAYOUT = frozenset(
    "area article bar block bottom box col column container content cookies div element global group holder inner item items left level link links list main nav outer page panel "
    "policy popular post posts primary region right row secondary section site slot stories text top unit wrap wrapper zone".split()
)
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|\Z)", re.S)
ATTRIBUTE = re.compile(r"(?:^|\s)(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
#: An open element of these is closed by the start of one of those.
CLOSES = {"p": BLOCK, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}}
#: Elements whose end tags don't reach beyond a block.
INLINE = frozenset("a b em font i span strong u".split())
#: Elements that stop the search for an open element to close.
CLOSERS = frozenset().union(*CLOSES.values())
SCOPE = frozenset("body html article section div main table td th ul ol dl blockquote".split())
#: Elements that may hold a text of several paragraphs; a paragraph or what is in it is never taken for the whole text.
HOLDERS = frozenset("body article section div main td center #root".split())
#: The least base of the logarithm that weighs links: without links the weight is the plain logarithm of characters and tags.
LEAST_BASE = math.e


@dataclass(slots=True, eq=False)
class Node:
    tag: str
    up: Node | None = None
    parts: list = field(default_factory=list)
    noise: bool = False
    #: Noise by its kind, by its tag, or by a word in its attributes (or a form): the last two may turn out to hold the text.
    mark: int = 0
    #: In an article or main element.
    inner: bool = False
    chars: int = 0
    link_chars: int = 0
    tags: int = 0
    link_tags: int = 0
    density: float = 0.0
    total: float = 0.0


def mark(tag: str, attributes: str, inner: bool) -> int:
    """How an element is marked as noise, one of HARD, BY_TAG and BY_WORD, or 0."""
    if tag in HARD_TAGS:
        return HARD
    if tag != "body" and tag != "html" and re.search(r"(?:^|\s)(?:hidden|aria-hidden=[\"']?true)(?:[\s\"'/]|$)|display:\s*none", attributes, re.I):
        return HARD if tag not in ("main", "article") else 0
    if tag in NOISE and not (tag == "header" and inner):
        return BY_WORD if tag == "form" else BY_TAG
    # In an article a header holds its title, whether by tag or by class.
    words = MARKS - {"header"} if inner else MARKS
    if tag in ("html", "body") or "=" not in attributes:
        return 0
    names = [set(re.findall(r"[a-z]+", name)) for _, *value in ATTRIBUTE.findall(attributes) for name in "".join(value).lower().split()]
    return BY_WORD if any(n & words and n <= words | LAYOUT for n in names) else 0


def settle(root: Node) -> None:
    """Decides which marked elements are noise, with all that is in them.

    A mark doesn't count on an element that holds the page's longest main or article (one without a mark of its own). Without such a main or
    article density decides: where the element with the largest sum, in the whole page but its scripts, lies under elements that are
    marked by a word, or one of its marked parts is denser than all unmarked ones together, these marks don't count, nor does one on an element
    that is as dense as the threshold on the way from there to the body.
    """
    nodes, stack = [], [root]
    while stack:
        node = stack.pop()
        nodes.append(node)
        for p in reversed(node.parts):
            if isinstance(p, Node):
                p.noise = p.mark == HARD
                if not p.noise:
                    stack.append(p)
    measure(nodes)
    texts = [n for n in nodes if n.tag in ("main", "article") and not n.mark and n.chars]
    held, free = max(texts, key=lambda n: (n.tag == "main", n.chars), default=None), set()
    if held is not None:
        free = {id(n) for n in upward(held)}
    else:
        body = next((n for n in nodes if n.tag == "body"), root)
        path = upward(densest(body), body)
        parts = [p for p in path[0].parts if isinstance(p, Node) and not p.noise]
        named = max((p.density for p in parts if p.mark == BY_WORD), default=0.0)
        if any(n.mark == BY_WORD for n in path) or named > sum(p.density for p in parts if not p.mark):
            limit = min(n.density for n in path)
            free = {id(n) for n in nodes if n.mark == BY_WORD and n.chars and (n in path or n.density >= limit)}
    for n in nodes:
        n.noise = n.up is not None and n.up.noise or bool(n.mark) and n.tag not in ("main", "article") and id(n) not in free


def upward(node: Node | None, end: Node | None = None) -> list[Node]:
    """An element and what it lies in, as far as `end`."""
    found = []
    while node is not None:
        found.append(node)
        node = None if node is end else node.up
    return found


def densest(body: Node) -> Node:
    """The element with the largest sum of densities among those that may hold a text."""
    return max((n for n in order(body) if n.tag in HOLDERS), key=lambda n: (n.total, n.chars), default=body)


def parse(page: str) -> Node:
    """A lenient tree: every start tag opens, unclosed elements end with their parents, unmatched end tags are skipped."""
    root = node = Node("#root")
    opened: Counter[str] = Counter()

    def leave(to: Node) -> None:
        nonlocal node
        while node is not to:
            opened[node.tag] -= 1
            node = node.up

    at = 0
    while at < len(page):
        m = TOKEN.search(page, at)
        if not m:
            break
        if m.start() > at:
            node.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        if not m[2]:
            continue
        tag = m[2].lower()
        if m[1]:
            if not opened[tag]:
                continue
            up = node
            while up is not root and up.tag != tag and not (tag in INLINE and up.tag in BLOCK):
                up = up.up
            if up is not root and up.tag == tag:
                leave(up.up)
            continue
        scan = node if tag in CLOSERS else root
        while scan is not root:
            if tag in CLOSES.get(scan.tag, ()):
                leave(scan.up)
                break
            if scan.tag in SCOPE:
                break
            scan = scan.up
        child = Node(tag, node, mark=mark(tag, m[3] or "", node.inner), inner=node.inner or tag in ("article", "main"))
        node.parts.append(child)
        if tag in VOID or (m[3] or "").endswith("/") and tag not in BLOCK:
            continue
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*(?:>|\Z)", re.I).search(page, at)
            at = end.end() if end else len(page)
            continue
        node = child
        opened[tag] += 1
    if at < len(page):
        node.parts.append(html.unescape(page[at:]))
    settle(root)
    return root


def order(root: Node) -> list[Node]:
    """All nodes, parents first, in page order; noise and what is in it left out."""
    found, stack = [], [root]
    while stack:
        node = stack.pop()
        found.append(node)
        stack.extend(p for p in reversed(node.parts) if isinstance(p, Node) and not p.noise)
    return found


def measure(nodes: list[Node]) -> None:
    for n in reversed(nodes):
        n.chars = sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        n.link_chars = n.tags = n.link_tags = 0
        for p in n.parts:
            if isinstance(p, Node) and not p.noise:
                n.chars += p.chars
                n.link_chars += p.link_chars
                n.tags += p.tags + 1
                n.link_tags += p.link_tags + (p.tag == "a")
        if n.tag == "a":
            n.link_chars = n.chars
    page = nodes[0]
    shared = page.link_chars / max(1, page.chars)
    for n in reversed(nodes):
        tags, links, link_tags = max(1, n.tags), max(1, n.link_chars), max(1, n.link_tags)
        base = max(LEAST_BASE, math.log(n.chars / max(1, n.chars - n.link_chars) * n.link_chars + shared * n.chars + math.e))
        ratio = n.chars / links * tags / link_tags
        n.density = n.chars / tags * (math.log(ratio) / math.log(base) if ratio > 1 else 0.0)
        n.total = sum(p.density for p in n.parts if isinstance(p, Node) and not p.noise)


def content(root: Node) -> set[int]:
    """The ids of the nodes whose whole text is the page's main text."""
    nodes = order(root)
    measure(nodes)
    body = next((n for n in nodes if n.tag == "body"), root)
    top = densest(body)
    if top.total <= 0:
        return {id(body)}
    way = upward(top, body)
    path, limit = {id(n) for n in way}, min(n.density for n in way)
    chosen, stack = {id(top)}, [body]
    while stack:
        n = stack.pop()
        if id(n) in chosen:
            continue
        if id(n) not in path and n.density >= limit and n.chars:
            chosen.add(id(max((x for x in order(n) if x is n or x.tag in HOLDERS), key=lambda x: (x.total, x is n))))
            continue
        stack.extend(p for p in n.parts if isinstance(p, Node) and not p.noise)
    return chosen


def blocks(root: Node, chosen: set[int]) -> list[str]:
    """The chosen nodes' text by block, in page order; white space in a block is one space."""
    out: list[str] = []
    line: list[str] = []

    def flush() -> None:
        if text := " ".join("".join(line).split()):
            out.append(text)
        line.clear()

    stack: list[tuple[Node | str | None, bool]] = [(root, False)]
    while stack:
        item, on = stack.pop()
        if item is None:
            flush()
        elif isinstance(item, str):
            if on:
                line.append(item)
        elif item.noise:
            if item.tag in BLOCK:
                flush()
        elif item.tag == "br":
            line.append(" ")
        else:
            on = on or id(item) in chosen
            if item.tag in BLOCK:
                flush()
                stack.append((None, on))
            stack.extend((p, on) for p in reversed(item.parts))
    flush()
    return out


def main_text(page: str | None) -> str:
    if not page or not page.strip():
        return ""
    root = parse(page)
    return "\n".join(blocks(root, content(root)))


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for every row of pages(page_id, url, html).

    A null or empty page gives an empty text; broken, truncated or plain text pages are read leniently and never fail.
    Null ids and urls are kept, repeated rows give equal results, the first of equally dense parts is taken, an empty table
    gives no rows, and other columns are ignored. Whole pages are read; each page is handled on its own, without a shuffle.
    """
    require(pages, "page_id", "url", "html")
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            for part in (rows.slice(i, 512) for i in range(0, rows.num_rows, 512)):
                texts = [main_text(x) for x in part.column(2).to_pylist()]
                yield batch(schema, page_id=part.column(0), url=part.column(1), text=texts, n_chars=[len(t) for t in texts])

    return pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), "html").mapInArrow(run, "page_id long, url string, text string, n_chars long")
