"""Main text of web pages by composite text density.

A page is cut into a tree of elements. Every node has its characters and tags,
and those inside links; its composite density is the characters per tag, adjusted
by how much of them is link text. Nodes are ranked by the sum of their children's
densities. The node with the largest sum is the main subtree; the smallest density
on its path to the body is the threshold, and what lies beside that path comes
along if it is as dense, or a heading. Where the subtree lies in a ``main`` or, without that, an
``article``, the outermost one is its bound: that is taken as a whole, since a page says so itself, and
beside its path only headings of the first rank and other articles that reach the threshold are.

Parts that are marked as something else (menus, forms, adverts, comments, ...) are left out wherever they
stand: by element, role or being hidden, and by their names. In an article only whole class names count, or
those of reader comments; headings and what holds an article's only ``h1`` are never left out by name.

Each page is a row of its own; tasks see batches of rows and no page meets another. Malformed pages are
repaired as browsers commonly do, in time that grows with their length: a tag that never ends is text, and
after ``TORN`` of them quotes in a tag that never ends are no longer looked for beyond the next ``<``.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_NAME = r"<(/?)([a-zA-Z][^\s/<>]*)"
#: A tag whose quoted values hold no tag; one whose values may; what is no element.
_TAG = re.compile(_NAME + r"((?:[^<>\"']|\"[^\"<]*\"|'[^'<]*')*)>")
_LOOSE_TAG = re.compile(_NAME + r"((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>")
_ASIDE = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^<>]*>", re.S)
TORN = 16
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody td tfoot th "
    "thead tr ul".split()
)
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An opening tag ends an open element of its group, up to the group's border.
_ENDS_P = _BLOCK - frozenset("body html td th tr tbody thead tfoot caption li dd dt legend summary".split())
_ENDS = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_OTHER = frozenset(
    "nav footer aside form button select textarea input script style noscript template iframe svg canvas object "
    "dialog menu head title option label audio video".split()
)
_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar dialog alert alertdialog".split())
_WORDS = re.compile(
    r"(?:^|[\s_-])(?:ads?|adverts?|advertis\w*|sponsor\w*|promos?|promotion|banner|cookies?|consent|gdpr|notices?|"
    r"notification|alert|popup|modal|overlay|newsletter|subscribe|sidebar|side-bar|widget|menu|navbar|nav|navigation|"
    r"breadcrumbs?|toolbar|masthead|footer|header|comments?|commentlist|disqus|replies|respond|related|recommend\w*|"
    r"share|sharing|social|pagination|pager|login|signup|search|skip)(?=$|[\s_-])",
    re.I,
)


#: Class names and ids of reader comments.
_COMMENTS = re.compile(r"comments?(?:[-_](?:area|box|feed|form|list|section|thread|wrapper))?|commentlist|disqus(?:_thread)?|respond", re.I)


class Node:
    __slots__ = (
        "tag", "parent", "parts", "other", "named", "within", "chars", "tags", "link_chars", "link_tags", "density", "total",
    )

    def __init__(self, tag: str, parent: Node | None) -> None:
        self.tag, self.parent = tag, parent
        self.other = self.named = False  # something else in itself, by its name
        self.within = parent is not None and (parent.within or parent.tag in ("article", "main"))
        self.parts: list[Node | str] = []


def _judge(node: Node, attributes: str) -> None:
    """Whether an element is something else than main text, in itself or by its name."""
    tag = node.tag
    if tag in _OTHER or tag == "header" and not node.within:
        node.other = True
        return
    if not attributes or tag in ("html", "body", "article", "main"):
        return
    at = {}
    for name, *values in _ATTRIBUTE.findall(attributes):
        at.setdefault(name.lower(), next((v for v in values if v), ""))
    node.other = (
        "hidden" in at
        or at.get("aria-hidden", "").lower() == "true"
        or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", at.get("style", ""), re.I) is not None
        or at.get("role", "").lower() in _ROLES
    )
    if tag in _HEADINGS:
        return
    classes, ident = at.get("class", ""), at.get("id", "")
    if node.within:
        whole = any(_WORDS.fullmatch(c) or _COMMENTS.fullmatch(c) for c in classes.split())
        node.named = whole or _COMMENTS.fullmatch(ident) is not None
    else:
        node.named = _WORDS.search(f"{classes} {ident}") is not None


def parse(page: str) -> Node:
    """The element tree; unclosed and stray tags are repaired as browsers commonly do."""
    root = node = Node("html", None)
    opened: Counter[str] = Counter()  # tags of the open elements
    at = look = torn = 0

    def leave(upto: Node) -> None:
        nonlocal node
        while node is not upto:
            opened[node.tag] -= 1
            node = node.parent

    while (look := page.find("<", look)) >= 0:
        m = _TAG.match(page, look) or _ASIDE.match(page, look)
        if not m and torn < TORN and page[look + 1 : look + 2].isalpha():
            m = _LOOSE_TAG.match(page, look)
            torn += not m
        if not m:
            look += 1
            continue
        if look > at:
            node.parts.append(html.unescape(page[at:look]))
        at = look = m.end()
        if m.re is _ASIDE:
            continue
        closing, tag, attributes = m.group(1), m.group(2).lower(), m.group(3)
        if closing:
            if opened[tag]:
                up = node
                while up.tag != tag:
                    # A cell or item isn't closed by what closes outside of it but inside its parent.
                    up = up.parent
                leave(up.parent)
            continue
        if tag in ("html", "body", "head"):
            if tag == "html":
                continue
            leave(root)
        elif tag in _ENDS or tag in _ENDS_P:
            closes, border = _ENDS.get(tag, (frozenset(["p"]), frozenset(["button", "table", "td", "th", "li"])))
            sought = sum(opened[c] for c in closes)
            if sought:
                up, last = node, None
                while sought and up is not None and up.tag not in border:
                    if up.tag in closes:
                        last = up
                        sought -= 1
                    up = up.parent
                if last is not None:
                    leave(last.parent)
        child = Node(tag, node)
        _judge(child, attributes)
        node.parts.append(child)
        if tag in _RAW:
            end = re.compile(rf"</{tag}\s*>", re.I).search(page, at)
            raw = page[at : end.start() if end else len(page)]
            child.parts.append(html.unescape(raw) if tag in ("title", "textarea") else raw)
            at = look = end.end() if end else len(page)
        elif tag not in _VOID and not attributes.rstrip().endswith("/") or tag in _BLOCK:
            node = child
            opened[tag] += 1
    if at < len(page):
        node.parts.append(html.unescape(page[at:]))
    _settle(root)
    return root


def _settle(root: Node) -> None:
    """What lies in something else is something else; names give way to an article's only ``h1``."""
    nodes = _walk(root)
    plain, spared = 0, []
    hidden: dict[int, tuple[bool, bool]] = {}  # in something else in itself, in something by name
    for n in nodes:
        inside, by_name = hidden[id(n.parent)] if n.parent is not None else (False, False)
        hidden[id(n)] = (inside or n.other, by_name or n.named)
        if n.tag == "h1" and not hidden[id(n)][0]:
            if hidden[id(n)][1]:
                spared.append(n)
            else:
                plain += 1
    if not plain and len(spared) == 1 and spared[0].within:
        up = spared[0]
        while up is not None and up.within:
            up.named = False
            up = up.parent
    for n in nodes:
        n.other = n.other or n.named or (n.parent is not None and n.parent.other)


def _walk(root: Node) -> list[Node]:
    """Nodes before their descendants, without recursion."""
    out, todo = [], [root]
    while todo:
        node = todo.pop()
        out.append(node)
        todo += [p for p in reversed(node.parts) if isinstance(p, Node)]
    return out


def measure(root: Node) -> None:
    """Characters, tags, link characters, link tags, density and density sum of every node."""
    nodes = _walk(root)
    for node in reversed(nodes):
        silent = node.tag in ("script", "style", "noscript", "template", "head")
        node.chars = node.tags = node.link_chars = node.link_tags = 0
        for p in () if silent else node.parts:
            if isinstance(p, str):
                node.chars += len("".join(p.split()))
            else:
                node.chars += p.chars
                node.tags += p.tags + 1
                node.link_chars += p.link_chars
                node.link_tags += p.link_tags
        if node.tag == "a":
            node.link_chars, node.link_tags = node.chars, node.tags + 1
    of_body = root.link_chars / max(1, root.chars)
    for node in reversed(nodes):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        base = log(c * node.link_chars / max(1, c - node.link_chars) + of_body * c + e)
        node.density = c / t * log(max(1.0, c / lc * t / lt)) / max(log(base), 0.05) if c else 0.0
        node.total = sum(p.density for p in node.parts if isinstance(p, Node))


def main_nodes(root: Node) -> list[Node]:
    """The roots of the main text, in page order."""
    measure(root)
    nodes = [n for n in _walk(root) if not n.other and n.chars]
    if not nodes:
        return []
    bodies = [n for n in nodes if n.tag == "body"]
    top = bodies[0] if bodies else root
    best = max(nodes, key=lambda n: (n.total, n.density, n.tag not in ("html",)))
    if best.total <= 0:  # text without elements
        best = top
    path, up = [], best
    while up is not None:
        path.append(up)
        up = up.parent
    threshold = min(n.density for n in path if n.chars)
    bound = next((n for n in reversed(path) if n.tag == "main"), None) or next(
        (n for n in reversed(path) if n.tag == "article"), None
    )
    core = bound or best
    taken = {id(core)}
    above = path[path.index(core) + 1 :]
    for node in above:
        for p in node.parts:
            if not isinstance(p, Node) or p.other:
                continue
            dense = p.density >= threshold > 0
            if bound is not None:
                fits = p.tag == "h1" or p.tag == bound.tag == "article" and dense
            else:
                fits = p.tag in _HEADINGS or dense
            if fits:
                taken.add(id(p))
    taken -= {id(n) for n in above}
    return [n for n in _walk(root) if id(n) in taken]


def blocks_of(roots: list[Node]) -> list[str]:
    """Text of the blocks below ``roots`` in page order, white space made single."""
    out: list[str] = []
    open_block: list[str] = []

    def close() -> None:
        text = " ".join("".join(open_block).split())
        if text:
            out.append(text)
        open_block.clear()

    for root in roots:
        close()
        todo: list[Node | str | None] = [root]
        while todo:
            item = todo.pop()
            if item is None:
                close()
            elif isinstance(item, str):
                open_block.append(item)
            elif item.other:
                # What is left out still parts blocks if it is one.
                if item.tag in _BLOCK:
                    close()
            elif item.tag == "br":
                open_block.append(" ")
            else:
                if item.tag in _BLOCK:
                    close()
                    todo.append(None)
                todo += reversed(item.parts)
        close()
    return out


def main_text(page: str | None) -> str:
    return "\n".join(blocks_of(main_nodes(parse(page)))) if page else ""


def extract(pages: DataFrame) -> DataFrame:
    """Per row of ``pages``: page_id, url, text, n_chars. A null page has empty text."""
    rows = pages.select(
        pages["page_id"].cast("long").alias("page_id"),
        pages["url"].cast("string").alias("url"),
        pages["html"].cast("string").alias("html"),
    )

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            yield pd.Series([main_text(x) for x in s], dtype=object)

    return rows.select("page_id", "url", text("html").alias("text")).withColumn(
        "n_chars", F.char_length("text").cast("long")
    )
