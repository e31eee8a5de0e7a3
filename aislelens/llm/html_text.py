"""Main text of web pages by composite text density."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from math import e, log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Elements by their role in a page.
_SKIPPED = frozenset("script style noscript template textarea title iframe svg math canvas object".split())
_BOILERPLATE = frozenset("nav footer aside form button select option menu dialog label input head".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 "
    "h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary table tbody tfoot thead tr caption ul".split()
)
_CONTAINER = frozenset("article blockquote body center dd details div fieldset figure html main section table td".split())
_SPACE = frozenset("br td th img wbr".split())
_CLOSES = {  # a start tag ends an open element of these, up to the given borders
    "li": (frozenset(["li"]), frozenset("ul ol menu dir".split())),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select"])),
}
_CLOSES_P = _BLOCK - frozenset("body html tr tbody thead tfoot caption".split())
_P_BORDER = frozenset("td th table caption button object html".split())
_ROLES = frozenset(
    "ad ads advert adverts advertisement advertising banner sponsor sponsored promo promotion cookie cookies consent gdpr notice "
    "notices alert popup modal overlay sidebar side menu nav navbar navigation breadcrumb breadcrumbs pagination pager share sharing "
    "social comment comments disqus respond reply replies footer header masthead topbar newsletter subscribe subscription signup "
    "login search related recommended widget widgets toolbar contentinfo complementary skip".split()
)
# Roles that are never the page itself, and roles that also occur in names of other things ("social-issues").
_COMMENT = frozenset("comment comments disqus respond reply replies".split())
_NOTICE = frozenset("ad ads advert adverts advertisement advertising sponsor sponsored cookie cookies consent gdpr newsletter".split())
_VAGUE = frozenset(
    "side social search notice notices related respond reply replies skip header alert share sharing comment subscribe login promotion "
    "recommended banner menu pager overlay subscription signup widget widgets".split()
)
# Words beside a vague role in the name of a part of the layout; words that say something else about a part.
_PARTS = frozenset(
    "a to site page top bottom left right main global primary secondary box bar list item items block wrapper wrap container section "
    "panel area inner outer link links form button buttons icon icons text body title post posts article articles story stories entry "
    "content row col column group toggle tool tools count counts us this".split()
)
_TURNS = frozenset("with without has have no non not and or by is of above below before after under enabled disabled open closed show hide".split())
# Words that name who wrote a part; words in names of what readers wrote, which also name other things.
_SIGNATURE = frozenset("author user username nick nickname poster commenter avatar byline signed timestamp permalink".split())
_READERS = frozenset("discussion discussions reaction reactions response responses feedback opinions thread threads conversation talk talkback community readers".split())
_ENTRY = frozenset("li div article section".split())
_HEADING = frozenset("h1 h2 h3 h4 h5 h6 hgroup".split())
_PROSE = frozenset("p blockquote pre".split())
_NEVER_ROLE = frozenset("html body article main".split())

_TOKEN = re.compile(
    r"<!--.*?(?:--!?>|\Z)|<[!?][^>]*+(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)(?:>|\Z)|</?([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)",
    re.S,
)
_MARKED = re.compile(r"class|id|role|hidden|style", re.I)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]++)(?:\s*+=\s*+(?:\"([^\"]*+)\"?|'([^']*+)'?|([^\s>\"']++)))?")
_NOT_SHOWN = re.compile(r"(?:^|;)\s*display\s*:\s*none\b", re.I)
_WHITE = re.compile(r"\s+")


class _Node:
    __slots__ = (
        "name", "parent", "parts", "chars", "tags", "link_chars", "link_tags", "density", "total", "dropped", "kind", "in_link", "in_page",
        "article", "label", "depth",
    )

    def __init__(self, name: str, parent: _Node | None, kind: str, label: str = "") -> None:
        self.name, self.parent, self.parts, self.kind, self.dropped = name, parent, [], kind, False
        self.label = label  # class names and id
        self.depth = 0 if parent is None else parent.depth + 1
        self.in_link = name == "a" or (parent is not None and parent.in_link)
        self.in_page = name in ("article", "main") or (parent is not None and parent.in_page)
        above = parent.article if parent is not None else None
        self.article = above or (self if name == "article" else None)  # the outermost one around it
        self.chars = self.tags = self.link_chars = self.link_tags = 0
        self.density = self.total = 0.0


def _attributes(raw: str) -> dict[str, str]:
    """Values by lower-case name, the first of each; empty if none of them can matter."""
    out: dict[str, str] = {}
    if _MARKED.search(raw):
        for name, double, single, bare in _ATTRIBUTE.findall(raw):
            out.setdefault(name.lower(), double or single or bare)
    return out


def _kind(name: str, attributes: dict[str, str], parent: _Node) -> str:
    """Why an element is furniture: hidden, fixed, comment, notice or part; ``reply`` is an article that is a comment; else empty."""
    if name in ("article", "main"):
        return "reply" if name == "article" and _role(name, attributes, _COMMENT) else ""
    if name in _NEVER_ROLE:
        return ""
    if attributes.get("hidden", "until-found").lower() != "until-found" or _NOT_SHOWN.search(attributes.get("style", "")):
        return "hidden"
    if name in _BOILERPLATE:
        return "part" if name in ("nav", "footer", "aside", "form", "dialog") else "fixed"
    if name != "header" and not attributes:
        return ""
    if name == "header" and not parent.in_page:
        return "part"
    if attributes.get("aria-hidden", "").strip().lower() == "true":
        return "part"
    return _role(name, attributes, _ROLES - {"header"} if parent.in_page else _ROLES)  # the header of an article belongs to it


def _role(name: str, attributes: dict[str, str], roles: frozenset) -> str:
    """What the element's class names, id and role make it; the id of a heading is a place to link to."""
    for key in ("class", "id", "role"):
        for word in attributes.get(key, "").split() if key != "id" or name not in _HEADING else ():
            tokens = {word.lower()} if key == "role" else set(re.findall("[a-z]+", re.sub(r"(?<=[a-z])(?=[A-Z])", " ", word).lower()))
            found = tokens & roles
            if found and not tokens & _TURNS and (found - _VAGUE or tokens <= roles | _PARTS):
                return "comment" if found & _COMMENT else "notice" if found & _NOTICE else "part"
    return ""


def _drop(nodes: list[_Node]) -> None:
    """Mark furniture and all inside it, unless it is the page itself.

    Without an article or main element outside of furniture, furniture that holds one stays,
    but for what is inside it. A part of the layout that holds over half of the text, links left
    out, stays if it is in an article or main element or if no such element holds text. Hidden
    elements and comments always go.
    """
    for node in nodes:
        node.chars = sum(len(_WHITE.sub(" ", p).strip()) for p in node.parts if isinstance(p, str))
    _mark_threads(nodes)
    if any(n.kind not in ("", "reply") for n in nodes):
        _keep_page(nodes)
    for node in nodes:
        node.dropped = node.kind not in ("", "reply") or (node.parent is not None and node.parent.dropped)


def _mark_threads(nodes: list[_Node]) -> None:
    """Mark what readers wrote as comments, whatever its name.

    That are two or more neighbouring elements of one name and class, each with a signature (a
    time, a citation or a class that names an author) and none with a heading, after more prose than they hold
    themselves. If a part of the page is named for its readers, neither two of them nor the
    prose is needed. The element that holds little else goes as a whole.
    """
    filled = dict.fromkeys(nodes, 0)
    signed: set[_Node] = set()
    headed: set[_Node] = set()
    prose, prose_before = 0, {}
    for node in nodes:
        prose_before[node] = prose
        filled[node] = node.chars
        if node.name in _PROSE or (node.parent is not None and node.parent.name in _PROSE):
            prose += node.chars
    words = {n: set(re.findall("[a-z]+", n.label)) for n in nodes if n.label}
    for node in reversed(nodes):
        if node.name in ("time", "cite") or words.get(node, _READERS) & _SIGNATURE:
            signed.add(node)
        if node.name in _HEADING:
            headed.add(node)
        if (up := node.parent) is not None:
            filled[up] += filled[node]
            if node in signed:
                signed.add(up)
            if node in headed:
                headed.add(up)
    if len(signed) < 2:
        return
    for node in nodes:
        entries: dict[tuple[str, str], list[_Node]] = {}
        for part in node.parts:
            if not isinstance(part, str) and part.name in _ENTRY and part in signed and part not in headed and not part.kind and filled[part]:
                entries.setdefault((part.name, re.sub(r"[0-9]+", "", part.label)), []).append(part)
        for own in entries.values():
            text, named = sum(filled[n] for n in own), _for_readers(node, words)
            if not named and (len(own) < 2 or prose_before[own[0]] <= text):
                continue
            if 3 * text < 2 * filled[node] or node.name in _NEVER_ROLE:
                for entry in own:
                    entry.kind = "comment"
                continue
            while node.parent is not None and node.parent.name not in _NEVER_ROLE and 3 * text >= 2 * filled[node.parent]:
                node = node.parent
            node.kind = node.kind or "comment"
            break


def _for_readers(node: _Node, words: dict[_Node, set[str]]) -> bool:
    """Whether the element or the one around it is named for what readers wrote."""
    around = (node, node.parent) if node.parent is not None else (node,)
    return any(words.get(n, frozenset()) & _READERS for n in around if n.name not in _NEVER_ROLE)


def _keep_page(nodes: list[_Node]) -> None:
    near: dict[_Node, _Node | None] = {}  # the furniture that a node is or is in
    never: set[_Node] = set()  # what can't be the page
    filled, text, shown = {}, {}, {}  # characters of a subtree: all, those that may be the page's without links, those outside furniture in it
    for node in nodes:
        up = node.parent
        near[node] = node if node.kind not in ("", "reply") else near[up] if up is not None else None
        if node.kind in ("hidden", "fixed", "comment", "reply") or up in never:
            never.add(node)
        filled[node] = shown[node] = node.chars
        text[node] = 0 if node.in_link or node.kind == "notice" or node in never else node.chars
    for node in reversed(nodes):
        if (up := node.parent) is not None:
            filled[up] += filled[node]
            text[up] += 0 if node.kind == "notice" else text[node]
            shown[up] += shown[node] if near[node] is not node else 0
    pages = [n for n in nodes if n.name in ("article", "main") and n not in never and shown[n]]
    if pages and not any(near[n] is None for n in pages):
        direct = {near[n] for n in pages}
        holding: set[_Node] = set()
        for up in direct:
            while up is not None and up not in holding:
                holding.add(up)
                up = up.parent
        stays: set[_Node] = set()  # furniture inside the page that was found
        for node in nodes:
            if node.parent in stays or (node.parent in direct and not node.parent.kind):
                stays.add(node)
            if node in holding and node.kind and node not in stays:
                node.kind = ""
    whole = text[next((n for n in nodes if n.name == "body" and n not in never), nodes[0])]
    inside: set[_Node] = set()
    for node in nodes:
        if node.name in ("article", "main") or node.parent in inside:
            inside.add(node)
        if node.kind == "part" and (node in inside or not pages) and node not in never and 2 * text[node] > whole:
            node.kind = ""


class _Open:
    """The open elements, found by their names."""

    def __init__(self, root: _Node) -> None:
        self.path, self.by_name = [root], {root.name: [root]}

    def top(self) -> _Node:
        return self.path[-1]

    def nearest(self, names: Iterable[str]) -> _Node | None:
        """The innermost open element of one of the names, besides the root."""
        found = [own[-1] for n in names if (own := self.by_name.get(n)) and own[-1].depth]
        return max(found, key=lambda n: n.depth, default=None)

    def push(self, node: _Node) -> None:
        self.path.append(node)
        self.by_name.setdefault(node.name, []).append(node)

    def close(self, node: _Node | None) -> None:
        """Close an element and all inside it."""
        while node is not None and len(self.path) > node.depth:
            self.by_name[self.path.pop().name].pop()

    def close_within(self, ends: frozenset, border: frozenset) -> None:
        """Close the innermost of ``ends`` unless an element of ``border`` is open inside it."""
        end, stop = self.nearest(ends), self.nearest(border)
        if end is not None and (stop is None or stop.depth < end.depth):
            self.close(end)


def _tree(html: str) -> list[_Node]:
    """All nodes, parents first, furniture marked."""
    root = _Node("html", None, "")
    nodes, opened, at, length, body = [root], _Open(root), 0, len(html), False
    while at < length:
        m = _TOKEN.search(html, at)
        text = html[at : m.start() if m else length]
        if text:
            opened.top().parts.append(unescape(text))
        if not m:
            break
        at = m.end()
        name = (m[1] or m[3] or "").lower()
        if not name:
            continue
        if html[m.start() + 1] == "/":
            opened.close(opened.nearest([name]))
            continue
        if name == "html" or (name == "body" and body):
            continue
        body = body or name == "body"
        if name in _CLOSES_P:
            opened.close_within(frozenset(["p"]), _P_BORDER)
        if name in _CLOSES:
            opened.close_within(*_CLOSES[name])
        if name == "body" and opened.top().name == "head":
            opened.close(opened.top())
        raw = m[2] or m[4] or ""
        empty = raw.rstrip().endswith("/")
        if name in _SKIPPED and not empty:
            end = re.compile(rf"</{name}\b[^>]*>?", re.I).search(html, at)
            at = end.end() if end else length
            continue
        attributes, parent = _attributes(raw) if raw else {}, opened.top()
        label = f"{attributes.get('class', '')} {attributes.get('id', '')}".strip().lower() if attributes else ""
        child = _Node(name, parent, _kind(name, attributes, parent), label)
        nodes.append(child)
        parent.parts.append(child)
        if name not in _VOID and not empty:
            opened.push(child)
    _drop(nodes)
    return nodes


def _measure(nodes: list[_Node]) -> None:
    """Characters, tags and densities of every kept node, children first; ``chars`` are its own before."""
    kept = [n for n in nodes if not n.dropped]
    for node in kept:
        node.link_chars = node.chars if node.in_link else 0
    for node in reversed(kept):
        if (up := node.parent) is not None:
            up.chars += node.chars
            up.link_chars += node.link_chars
            up.tags += node.tags + 1
            up.link_tags += node.link_tags + (node.name == "a")
    body = next((n for n in kept if n.name == "body"), kept[0])
    share = body.link_chars / max(1, body.chars)
    for node in reversed(kept):
        c, t, lc, lt = node.chars, max(1, node.tags), max(1, node.link_chars), max(1, node.link_tags)
        if c:
            base = log(c / max(1, c - node.link_chars) * node.link_chars + share * c + e)
            node.density = c / t * log(1 + (c - node.link_chars) / lc * t / lt) / max(0.1, log(base))
        if node.parent is not None:
            node.parent.total += node.density


def _chosen(nodes: list[_Node]) -> set[_Node]:
    """The container with the largest sum, and those that reach the threshold of its path to the body.

    The largest one stands for its whole article or main element, and brings the headings and
    prose around it along. Paragraphs and inline elements are not chosen by density: their
    container is.
    """
    kept = [n for n in nodes if not n.dropped]
    body = next((n for n in kept if n.name == "body"), kept[0])
    best: dict[_Node, _Node] = {}  # the container of the largest sum in each subtree
    for node in reversed(kept):
        own = best.get(node)
        if (own is None or node.total >= own.total) and (node is body or node.name in _CONTAINER):
            own = best[node] = node
        if own is not None and (up := node.parent) is not None and (up not in best or own.total > best[up].total):
            best[up] = own
    top, threshold, path = best[body], float("inf"), set()
    node = top
    while node is not None:
        threshold = min(threshold, node.density)
        path.add(node)
        node = None if node is body else node.parent
    dense = {n for n in kept if n.name in _CONTAINER and n not in path and n.density >= threshold and n.density > 0}
    whole = _whole(top)
    return {whole} | {n.article or n for n in dense} | _around(kept, top, whole)


def _whole(top: _Node) -> _Node:
    """The outermost article, else the nearest main element, else the container itself."""
    up: _Node | None = top
    while up is not None and up.name != "main":
        up = up.parent
    return top.article or up or top


def _unlinked(node: _Node) -> int:
    return node.chars - node.link_chars


def _around(kept: list[_Node], top: _Node, whole: _Node) -> set[_Node]:
    """Headings and prose beside the chosen container or beside what holds it.

    Outside of an article or main element only the h1, if there is none inside, and the prose
    between it and the element. A container beside counts as prose if it holds a paragraph,
    more text than links, and at least half the text for each tag that the largest one has;
    unlike the density, that does not grow with the number of tags.
    """
    holds_prose, holds_title = set(), set()
    for node in kept:
        marks = (holds_prose,) if node.name in _PROSE and _unlinked(node) else (holds_title,) if node.name == "h1" and node.chars else ()
        for mark in marks:
            up: _Node | None = node
            while up is not None and up not in mark:
                mark.add(up)
                up = up.parent
    rate = _unlinked(top) / max(1, top.tags) / 2

    def is_prose(node: _Node) -> bool:
        if 2 * node.link_chars >= node.chars or node not in holds_prose:
            return False
        return node.name in _PROSE or (node.name in _CONTAINER and _unlinked(node) / max(1, node.tags) >= rate)

    found: set[_Node] = set()
    child, up = whole, whole.parent
    bounded, titled = whole.name in ("article", "main"), whole in holds_title
    inside_main = whole.name == "article" and _inside(whole, "main")
    while up is not None:
        beside = [p for p in up.parts if not isinstance(p, str) and not p.dropped and p.chars]
        if not bounded or inside_main:
            found |= {p for p in beside if p is not child and (p.name in _HEADING or is_prose(p))}
        elif not titled:
            before = beside[: beside.index(child)] if child in beside else []
            first = next((i for i, p in enumerate(before) if p.name in ("h1", "hgroup") and p in holds_title), None)
            if first is not None:
                found |= {p for p in before[first:] if p.name in _HEADING or is_prose(p)}
                titled = True
        if up.name == "main":
            inside_main, bounded = False, True
            titled = titled or up in holds_title
        child, up = up, up.parent
    return found


def _inside(node: _Node, name: str) -> bool:
    up = node.parent
    while up is not None and up.name != name:
        up = up.parent
    return up is not None


def main_text(html: str | None) -> str:
    """Blocks of the page's main text, joined by an empty line."""
    if not html:
        return ""
    nodes = _tree(html)
    _measure(nodes)
    chosen = _chosen(nodes)
    blocks: list[list[str]] = [[]]
    stack: list = [(nodes[0], nodes[0] in chosen)]
    while stack:
        item, inside = stack.pop()
        if item is None:
            blocks.append([])
        elif isinstance(item, str):
            blocks[-1].append(item)
        elif item.dropped:
            blocks[-1].append(" ")
        else:
            inside = inside or item in chosen
            border = [(None, inside)] if item.name in _BLOCK else [(" ", inside)] if item.name in _SPACE else []
            content = [(p, inside) for p in item.parts if inside or not isinstance(p, str)]
            stack += reversed([*border, *content, *border])
    texts = (_WHITE.sub(" ", "".join(b)).strip() for b in blocks)
    return "\n\n".join(t for t in texts if t)


def _extracted(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for pages in batches:
        yield pd.Series([main_text(p) for p in pages], dtype=object)


def extract(pages: DataFrame) -> DataFrame:
    """Main text of every page, one row per input row: page_id, url, text, n_chars.

    Menus, headers, footers, sidebars, notices, adverts, forms, scripts, styles and comments
    are left out by element and by class, id or role, unless they hold the page; what is left is chosen by density, as
    whole articles with the headings and paragraphs beside them.
    Null or empty html, or a page without text, gives an empty text. Character references are
    decoded and white space inside a block is one space.
    """
    extracted = F.pandas_udf(_extracted, "string")
    return pages.select("page_id", "url", extracted("html").alias("text")).withColumn("n_chars", F.length("text").cast("bigint"))
