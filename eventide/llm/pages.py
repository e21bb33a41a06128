"""Main text of HTML pages by tree scoring.

A page is read into a tree. Paragraphs earn points for length and commas and pass them to their
ancestors, less with each step up; an ancestor's points are discounted by its link density and
weighed by what its tag and its class say. The article or main element around the best container
is kept whole; where there is none, the container and, at every level up to the body, those of
its siblings that score or read like text, with their headings. Pages are independent rows, so the work is row-local.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from eventide.llm.common import fresh, in_batches, with_column

# Comments, raw-text elements whole, declarations, tags (quoted values may hold >), broken tags.
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|noscript|template|textarea|title|iframe|svg|math|object|select)\b(?P<rest>[^>]*)(?:>.*?(?:</(?P=raw)\s*>|\Z)|\Z)"
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/>]*)(?P<attrs>(?>[^>\"']+|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<tag2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
NAMES = re.compile(r"(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.I)
HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html li main nav ol p pre section summary table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT_TAGS = frozenset("p pre blockquote td li dd h1 h2 h3 h4 h5 h6 figcaption".split())
# What an opening tag closes if it is open.
CLOSES = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}}
BARRIER = frozenset("table ul ol dl td th div article section main aside body html".split())
DROPPED = frozenset("nav footer aside form button dialog menu fieldset input label".split())
TAG_POINTS = {"article": 25.0, "main": 20.0, "section": 5.0, "div": 3.0, "td": 1.0, "blockquote": 3.0, "ul": -5.0, "ol": -5.0, "dl": -5.0, "body": -3.0}

WORDS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")
BAD = frozenset(
    "ad ads advert adverts advertisement adsense sponsor sponsored promo promotion nav navbar navigation menu breadcrumb breadcrumbs sidebar side "
    "footer foot masthead banner cookie cookies consent gdpr notice popup modal overlay comment comments disqus respond reply replies "
    "share sharing social related recommended newsletter subscribe signup login widget pagination pager toolbar skip search rail complementary "
    "contentinfo".split()
)
# Words that speak against main text alone or beside a word of the page's furniture, not in a name like "related-work".
WEAK = frozenset("ad ads foot notice promo rail recommended related search share side skip widget".split())
FURNITURE = BAD | frozenset(
    "area article articles bar block body box button buttons card cards col column container content form grid header icon icons item items label "
    "link links list main more news page panel posts results section slot stories tags text title to top unit video videos wrap wrapper zone".split()
)
MUTED = frozenset("button label".split())  # inside a paragraph: what they say goes, up to their end or the end of the block
GOOD = frozenset("article body content entry main post story text blog page column".split())


class Node:
    __slots__ = ("tag", "up", "bad", "good", "chars", "links", "points", "blocks", "kids")

    def __init__(self, tag: str, up: Node | None, bad: bool, good: bool):
        self.tag, self.up, self.bad, self.good = tag, up, bad, good
        self.chars = self.links = 0
        self.points = 0.0
        self.blocks: list[str] = []
        self.kids: list[Node] = []


def described(tag: str, attrs: str, inside: bool) -> tuple[bool, bool]:
    """Whether the tag or its names speak against main text, or for it."""
    if tag in DROPPED or (tag == "header" and not inside):
        return True, False
    if not attrs or "=" not in attrs and "hidden" not in attrs:
        return False, False
    if HIDDEN.search(attrs):
        return True, False
    names = [[w.lower() for w in WORDS.findall(name)] for m in NAMES.findall(attrs) for v in m for name in v.split()]
    good = any(GOOD & set(name) for name in names)
    found = {w for name in names for w in name if w in BAD and not (w in WEAK and any(o not in FURNITURE and not o.isdigit() for o in name))}
    bad = bool(found) and tag not in ("body", "html", "article", "main")
    # A container may name both ("content-sidebar-wrap"): then its own contents decide.
    return bad and not (good and tag in ("div", "section")) or bool(found & {"comment", "comments", "sidebar", "ad", "ads"}) and bad, good


def read(page: str) -> Node:
    root = Node("html", None, False, False)
    at, open_links, text, linked, muted = root, 0, [], 0, 0

    def flush() -> None:
        nonlocal linked
        if text:
            said = " ".join("".join(text).split())
            if said:
                at.blocks.append(said)
                at.kids.append(said)
                n, links = len(said), min(linked, len(said))
                score = 1 + said.count(",") + said.count("，") + min(n / 100, 3.0) if n >= 25 else n / 50
                score *= 1 - links / n
                if at.tag not in TEXT_TAGS:
                    score *= 0.7
                up, step, share = at.up if at.tag in TEXT_TAGS else at, 0, 1.0
                node = at
                while node is not None:
                    node.chars += n
                    node.links += links
                    node = node.up
                while up is not None and step < 5:
                    up.points += score * share
                    step += 1
                    share = 0.5 if step == 1 else 1 / (3 * step)
                    up = up.up
        text.clear()
        linked = 0

    def say(raw: str) -> None:
        nonlocal linked
        if raw and not muted:
            said = html.unescape(raw) if "&" in raw else raw
            text.append(said)
            if open_links:
                linked += len(said)

    where = 0
    for m in TOKEN.finditer(page):
        say(page[where : m.start()])
        where = m.end()
        tag = (m["tag"] or m["tag2"] or "").lower()
        if not tag:
            continue
        if tag in MUTED:
            text.append(" ")
            muted = max(0, muted - 1) if m["end"] or m["end2"] else muted + 1
            continue
        if tag in BLOCKS:
            muted = 0
        if m["end"] or m["end2"]:
            if tag == "a":
                open_links = 0
            elif tag in BLOCKS:
                flush()
                node = at
                while node is not None and node.tag != tag:
                    node = node.up
                if node is not None and node.up is not None:
                    at = node.up
            continue
        if tag == "br":
            text.append(" ")
        elif tag == "a":
            open_links = 1
        elif tag in BLOCKS:
            flush()
            open_links = 0 if tag not in ("h1", "h2", "h3", "h4", "h5", "h6", "div", "p") else open_links
            if tag in ("html", "body") and at.up is not None:
                continue
            if tag == "hr":
                continue
            node = at  # an open paragraph or heading ends before a block
            if node.tag in ("p", "h1", "h2", "h3", "h4", "h5", "h6") and node.up is not None:
                at = node.up
            closes = CLOSES.get(tag)
            if closes:
                node, last = at, None
                while node is not None and (node.tag in closes or node.tag not in BARRIER):
                    if node.tag in closes:
                        last = node
                    node = node.up
                if last is not None and last.up is not None:
                    at = last.up
            inside = False
            if tag == "header":
                node = at
                while node is not None:
                    inside |= node.tag in ("article", "main")
                    node = node.up
            bad, good = described(tag, m["attrs"] or m["attrs2"] or "", inside)
            child = Node(tag, at, bad or at.bad, good)
            at.kids.append(child)
            at = child
        elif tag in DROPPED:
            text.append(" ")
    say(page[where:])
    flush()
    return root


def score(node: Node) -> float:
    density = node.links / node.chars if node.chars else 0.0
    return (node.points + TAG_POINTS.get(node.tag, 0.0) * bool(node.chars) + 10.0 * node.good) * (1 - density)


def containers(root: Node) -> Iterator[Node]:
    stack = [root]
    while stack:
        node = stack.pop()
        if node.bad:
            continue
        yield node
        stack.extend(k for k in reversed(node.kids) if isinstance(k, Node))


def texts(node: Node) -> Iterator[str]:
    """The blocks below a container in page order, without what speaks against main text or is made of links."""
    stack: list = [node]
    while stack:
        k = stack.pop()
        if isinstance(k, str):
            yield k
        elif not k.bad and not (k is not node and k.tag in ("ul", "ol", "dl", "table", "div", "section", "li") and k.chars and k.links > 0.5 * k.chars):
            stack.extend(reversed(k.kids))


def main_text(page: str | None) -> str:
    """Blocks of the main text joined by two line ends; empty if there is none."""
    if not page:
        return ""
    root = read(page)
    best, top = None, 0.0
    for node in containers(root):
        if node.tag in TEXT_TAGS and node.tag not in ("td", "blockquote") or not node.chars:
            continue
        s = score(node)
        if best is None or s > top:
            best, top = node, s
    if best is None:
        return "\n\n".join(t for t in texts(root))
    # An article or main element is kept whole: its best part decides only where to look.
    node, whole = best, None
    while node is not None:
        whole = node if node.tag in ("article", "main") else whole
        node = node.up
    found = list(texts(whole or best))
    node = whole or best
    while node.up is not None:
        found = around(node, found, top, whole is None)
        node = node.up
        if whole is not None or node.tag in ("body", "html"):
            break
    return "\n\n".join(found)


def around(node: Node, own: list[str], top: float, wide: bool) -> list[str]:
    """The texts of a container with those of its siblings that score or read like text, and the headings before any of them.

    ``wide``: also siblings in which some paragraph reads like text.
    """
    out: list[list[str]] = []
    later = False
    for k in reversed(node.up.kids):
        if k is node:
            out.append(own)
            later = True
        elif isinstance(k, Node) and not k.bad and k.chars and k.tag != "header":
            density = k.links / k.chars
            heading = k.tag in HEADINGS and later and density < 0.25
            told = wide and density < 0.25 and any(reads(x) or lists(x) for x in containers(k))
            if score(k) >= max(10.0, 0.2 * top) or heading or reads(k) or told:
                out.append(list(texts(k)))
                later = True
    return [t for part in reversed(out) for t in part]


def reads(k: Node) -> bool:
    """A paragraph with few links that is long or a sentence."""
    if k.tag != "p" or not k.chars or k.links >= 0.25 * k.chars:
        return False
    return k.chars > 80 or any(b.endswith((".", "!", "?")) for b in k.blocks) and not k.links


def lists(k: Node) -> bool:
    """A list or table without links that says more than a few words."""
    return k.tag in ("ul", "ol", "dl", "table") and not k.links and k.chars > 40


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """Adds ``text``, the main text of each page, and ``n_chars``, its code points.

    Null and empty pages, and pages without any text outside menus, forms and the like, give an
    empty text. Each row is read alone and whole; repeated rows, null ids and other columns do not
    matter, and columns named ``text`` or ``n_chars`` are replaced. An empty table gives an empty
    table.
    """
    pages = fresh(pages, "text", "n_chars")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [main_text(p) for p in batch.column(batch.schema.get_field_index(html_col)).to_pylist()]
            batch = with_column(batch, "text", pa.array(found, pa.string()))
            yield with_column(batch, "n_chars", pa.array(map(len, found), pa.int64()))

    return in_batches(pages, run, T.StructType([*pages.schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())]))
