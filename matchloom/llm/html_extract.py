"""Main text of web pages by tree scoring.

A tolerant parser builds the element tree.  Elements that are boilerplate by
their kind, role, class or id go first.  Each paragraph then passes points to
its ancestors, fewer with each level: one, one for every comma and one for every
hundred characters up to three.  An element's points are discounted by the share
of its text that lies in links; the best container is kept with those siblings
that look like parts of the same article.

Defined cases: a null or empty html, or one without any article text, gives an
empty text; character references are decoded, also unknown ones as they stand;
unclosed, crossed and cut-off tags are closed where the standard's rules for
implied ends put them; rows without a page_id stay, with a null id; rows that
repeat an id each get a row; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Rows, slices

_NAME = re.compile(r"<(/?)([a-zA-Z][^\s/>]{0,63})")
_SPECIAL = re.compile("[>\"']")
_LOOSE = re.compile(r"</?[a-zA-Z][^<>]*>?")
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
#: Their content is no markup.
RAW = set("script style textarea title noscript template iframe xmp noembed noframes".split())
BLOCK = set(
    "address article aside blockquote body br center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul".split()
)
_CLOSES_P = BLOCK - {"br", "body", "html", "option", "tbody", "td", "tfoot", "th", "thead", "tr"}
#: Start tags that end an open element of these kinds, up to the scope that holds them.
IMPLIED = {
    "li": ({"li"}, {"ol", "ul", "menu", "dir"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "body": ({"head"}, {"html"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th"}, {"table"}), "tfoot": ({"tbody", "thead", "tr", "td", "th"}, {"table"}),
}
DROPPED = set("nav footer aside form script style noscript template iframe svg math canvas button select option textarea input dialog object embed head title audio video map menu dir fieldset legend label".split())
ROLES = set("navigation banner contentinfo complementary search dialog alertdialog alert menu menubar toolbar status".split())
#: Words of a class or id that mark boilerplate whatever the element holds.
MARKED = set(
    "ad ads adv advert adverts advertisement advertisements advertising adsense adslot adbox sponsor sponsored sponsors promo promos promotion outbrain taboola "
    "comment comments commentlist disqus replies respond discussion reviews "
    "nav navbar navigation menu menus breadcrumb breadcrumbs pagination pager footer sitefooter copyright colophon masthead "
    "cookie cookies consent gdpr popup modal overlay newsletter subscribe subscription signup login share sharing social".split()
)
#: Words that mark it unless the element holds most of the page's text.
LIKELY = set("sidebar sidebars sidenav rail aside related recommended recommendations widget widgets trending popular header topbar banner notice notices alert disclaimer legal toolbar search poll paywall skip tags toc hidden outro teaser teasers byline".split())
_PREFIXES = ("sidebar", "comment", "advert", "cookie", "breadcrumb", "newsletter", "sponsor", "pagination")
_KEPT = {"html", "body", "article", "main"}
WEIGHT = {"article": 25, "main": 15, "div": 5, "section": 5, "blockquote": 3, "pre": 3, "td": 3, "ol": -3, "ul": -3, "dl": -3, "li": -3, "address": -3, "th": -5}
_PARAGRAPH = {"p", "pre", "blockquote", "td", "div", "section", "article", "main", "body", "html", "li", "dd", "center", "figcaption", "h2", "h3"}


#: Elements open at once; deeper ones stand beside what would hold them, as in browsers.
DEPTH = 512


class Node:
    __slots__ = ("tag", "attrs", "parent", "children", "depth", "size", "links", "commas", "points")

    def __init__(self, tag: str, attrs: str, parent: Node | None):
        self.tag, self.attrs, self.parent = tag, attrs, parent
        self.depth = parent.depth + 1 if parent else 0
        self.children: list[Node | str] = []
        self.size = self.links = self.commas = 0
        self.points = 0.0


class TagEnds:
    """Where tags end: the next ``>`` outside quotes.  Places are looked at once, so any page takes time by its length."""

    def __init__(self, source: str):
        self.source = source
        self.known: dict[int, int] = {}  # by the place of a sign that is met outside quotes
        self.last = source.rfind(">")
        self.seen = (0, -1)  # no sign between the two

    def _sign(self, at: int) -> int:
        begun, sign = self.seen
        if not begun <= at <= sign:
            m = _SPECIAL.search(self.source, at)
            sign = m.start() if m else len(self.source)
            self.seen = (at, sign)
        return sign

    def after(self, at: int) -> int:
        """The place, or -1 where a quote or the tag doesn't end."""
        if at > self.last:
            return -1
        path, end = [], -1
        while (sign := self._sign(at)) < len(self.source):
            if sign in self.known:
                end = self.known[sign]
                break
            path.append(sign)
            if self.source[sign] == ">":
                end = sign
                break
            close = self.source.find(self.source[sign], sign + 1)
            if close < 0:
                break
            at = close + 1
        self.known.update(dict.fromkeys(path, end))
        return end


def _closes(here: Node, root: Node, tag: str) -> Node:
    """Where a new element of this kind goes: implied ends come first."""
    if tag in _CLOSES_P:
        node = here
        while node is not None and node.tag not in ("p", "button", "td", "th", "table"):
            if node.tag in BLOCK:
                node = None
                break
            node = node.parent
        if node is not None and node.tag == "p":
            here = node.parent
    if tag in IMPLIED:
        ended, scope = IMPLIED[tag]
        node, last = here, None
        while node is not None and node.tag not in scope:
            if node.tag in ended:
                last = node
            node = node.parent
        if last is not None:
            here = last.parent
    return here


def parse(source: str) -> Node:
    root = Node("html", "", None)
    at, here, n = 0, root, len(source)
    ends, beside = TagEnds(source), Counter()
    while at < n:
        open_ = source.find("<", at)
        if open_ < 0:
            here.children.append(source[at:])
            break
        if open_ > at:
            here.children.append(source[at:open_])
        if source.startswith("<!--", open_):
            end = source.find("-->", open_ + 2)
            at = n if end < 0 else end + 3
            continue
        m = _NAME.match(source, open_)
        if not m:
            # A declaration, an end without a name, or a sign like any other.
            end = source.find(">", open_) if source[open_ + 1 : open_ + 2] in ("!", "?", "/") and open_ < ends.last else -1
            if end < 0:
                here.children.append("<")
            at = open_ + 1 if end < 0 else end + 1
            continue
        end = ends.after(m.end())
        if end < 0:  # a quote that never ends, or the page is cut off inside a tag
            at = _LOOSE.match(source, open_).end()
            continue
        attrs, tag, at = source[m.end() : end], m[2].lower(), end + 1
        if m[1]:
            if beside[tag]:
                beside[tag] -= 1
                continue
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node is not root:
                here = node.parent
            elif tag == "p":
                here.children.append(Node("p", "", here))
            continue
        if tag == "html":
            continue
        here = _closes(here, root, tag)
        child = Node(tag, attrs, here)
        here.children.append(child)
        if tag in RAW:
            close = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(source, at)
            if close is None:
                break
            end = source.find(">", close.end())
            at = n if end < 0 else end + 1
        elif tag not in VOID and (tag in BLOCK or not attrs.endswith("/")):
            if child.depth < DEPTH:
                here = child
            else:
                beside[tag] += 1
    return root


def _attributes(node: Node) -> dict[str, str]:
    return {k.lower(): v.strip("\"'") for k, v in _ATTRIBUTE.findall(node.attrs)} if node.attrs else {}


def _marks(node: Node, wraps: bool = False) -> tuple[bool, bool]:
    """Whether the element is boilerplate for sure, and whether it likely is; words say nothing sure of one that ``wraps`` the page's text."""
    tag = node.tag
    if tag in DROPPED:
        return True, True
    a = _attributes(node)
    if not a:
        return False, tag == "header"
    if "hidden" in a or a.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", a.get("style", "")):
        return tag not in ("html", "body"), True
    if tag in _KEPT:
        words = set()
        if tag != "article":
            return False, False
    if a.get("role", "").lower() in ROLES:
        return True, True
    words = {w.lower() for w in _WORDS.findall(f"{a.get('class', '')} {a.get('id', '')}")}
    if words & MARKED or any(w.startswith(_PREFIXES) and w not in LIKELY for w in words):
        return not wraps, True
    return False, tag == "header" or bool(words & LIKELY)


def _measure(root: Node) -> None:
    """Sizes, sizes in links and commas of all elements, from the leaves up."""
    order, stack = [], [(root, False)]
    while stack:
        node, in_link = stack.pop()
        order.append((node, in_link))
        in_link = in_link or node.tag == "a"
        for child in node.children:
            if isinstance(child, str):
                size = len(" ".join(child.split()))
                node.size += size
                node.commas += child.count(",") + child.count("，") + child.count("、")
                if in_link:
                    node.links += size
            else:
                stack.append((child, in_link))
    for node, _ in reversed(order):
        if node.parent is not None:
            node.parent.size += node.size
            node.parent.links += node.links
            node.parent.commas += node.commas


def _prune(root: Node) -> None:
    total = max(1, root.size)
    lead = next((x for x in _walk(root) if x.tag in ("article", "main")), None)
    related, at = {id(x) for x in _walk(lead)} if lead else set(), lead
    while at is not None:
        related.add(id(at))
        at = at.parent

    def wraps(node: Node) -> bool:
        """Half of the page or more, and not beside its article: has-navbar, comments-open and the like."""
        return 2 * node.size >= total and (lead is None or id(node) in related)

    stack = [(root, False)]
    while stack:
        node, inside = stack.pop()
        kept = []
        for child in node.children:
            if isinstance(child, str):
                kept.append(child)
                continue
            sure, likely = _marks(child, wraps(child))
            if sure or (likely and 2 * child.size < total and not (inside and child.tag == "header")):
                continue
            if inside and child.tag == "header":
                # An article's own head: its headings are the article's.
                child.children = [x for x in child.children if isinstance(x, Node) and re.fullmatch("h[1-6]|hgroup", x.tag)]
            kept.append(child)
            stack.append((child, inside or child.tag in ("article", "main")))
        node.children = kept


def _walk(root: Node):
    stack = [root]
    while stack:
        node = stack.pop()
        yield node
        stack.extend(c for c in reversed(node.children) if not isinstance(c, str))


def _density(node: Node) -> float:
    return node.links / node.size if node.size else 0.0


def _own_text(node: Node) -> tuple[int, int]:
    """Characters and commas of a paragraph without those of blocks inside it."""
    size = commas = 0
    stack = list(node.children)
    while stack:
        child = stack.pop()
        if isinstance(child, str):
            size += len(child.strip())
            commas += child.count(",") + child.count("，") + child.count("、")
        elif child.tag not in BLOCK or child.tag == "br":
            stack.extend(child.children)
    return size, commas


def main_nodes(root: Node) -> list[Node]:
    """The best container and the siblings that belong to it, in page order."""
    _measure(root)
    _prune(root)
    for node in _walk(root):
        node.size = node.links = node.commas = 0
    _measure(root)
    scored: dict[int, Node] = {}
    for node in _walk(root):
        if node.tag not in _PARAGRAPH:
            continue
        size, commas = _own_text(node)
        if size < 25:
            continue
        points = 1 + commas + min(size / 100, 3)
        holder = node if node.tag not in ("p", "pre", "li", "dd", "h2", "h3", "figcaption") else node.parent
        for level, share in enumerate((1, 0.5, 1 / 6, 1 / 9)):
            if holder is None:
                break
            if id(holder) not in scored:
                holder.points = WEIGHT.get(holder.tag, 0)
                scored[id(holder)] = holder
            holder.points += points * share
            holder = holder.parent
    for node in scored.values():
        node.points *= 1 - _density(node)
    best = max(scored.values(), key=lambda x: x.points, default=None)
    if best is None:
        found = [x for x in _walk(root) if x.tag in ("article", "main") and x.size]
        return found[:1] or [next((x for x in _walk(root) if x.tag == "body"), root)]
    holder, up = best, best
    while up is not None:  # a part of an article: the whole
        if up.tag in ("article", "main"):
            holder = up
            break
        up = up.parent
    if holder.parent is None or holder.tag in ("main", "body"):
        return [holder]
    least = max(10, 0.2 * best.points)
    kept = []
    for sibling in holder.parent.children:
        if isinstance(sibling, str):
            continue
        if sibling is holder:
            kept.append(sibling)
        elif sibling.tag == "p":
            size, _ = _own_text(sibling)
            end = "".join(x for x in sibling.children if isinstance(x, str)).rstrip()[-1:]
            if (size > 80 and _density(sibling) < 0.25) or (0 < size <= 80 and not sibling.links and end in (".", "!", "?", "…")):
                kept.append(sibling)
        elif sibling.points >= least and _density(sibling) < 0.25:
            kept.append(sibling)
        elif re.fullmatch("h[1-3]", sibling.tag) and holder.tag not in ("article", "main") and not sibling.links:
            kept.append(sibling)
    return kept


def blocks(source: str) -> list[str]:
    """The main text's blocks in page order, each with single spaces."""
    out: list[str] = []
    part: list[str] = []

    def end():
        if part and (text := " ".join(html.unescape("".join(part)).split())):
            out.append(text)
        part.clear()

    for node in main_nodes(parse(source)):
        stack: list = [node]
        while stack:
            item = stack.pop()
            if isinstance(item, str):
                part.append(item)
            elif item is None:
                end()
            else:
                if item.tag in BLOCK:
                    end()
                    stack.append(None)
                stack.extend(reversed(item.children))
        end()
    return out


_TEXT = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("text", pa.string()), ("n_chars", pa.int64())])
_BLOCKS = pa.schema([*_TEXT, ("blocks", pa.list_(pa.string()))])


def extract(pages: DataFrame, with_blocks: bool = False) -> DataFrame:
    """``page_id, url, text, n_chars`` of all pages (``with_blocks``: and the blocks)."""
    schema = _BLOCKS if with_blocks else _TEXT

    def run(batches):
        out = Rows(schema)
        for rows in slices(batches, 64):
            for page, url, source in zip(rows["page_id"], rows["url"], rows["html"]):
                found = blocks(source or "")
                text = " ".join(found)
                if out.add(page, url, text, len(text), *[found] * with_blocks, size=128 + len(text) * (1 + with_blocks)):
                    yield out.batch()
        yield out.batch()

    own = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return own.mapInArrow(run, "page_id long, url string, text string, n_chars long" + ", blocks array<string>" * with_blocks)
