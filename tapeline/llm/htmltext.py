"""Main text of web pages by composite text density over the DOM."""

from __future__ import annotations

import html
import math
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: What HTML says of its elements, and names that pages give to what isn't the article.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
CLOSES_P = BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot", "caption", "body", "html", "li", "dd", "dt"}
KEEPS_P = frozenset("table td th button object".split())
SIBLING = {"li": ("li", {"ul", "ol", "menu", "dir"}), "dt": ("dt dd", {"dl"}), "dd": ("dt dd", {"dl"}), "tr": ("tr td th", {"table"}), "td": ("td th", {"tr", "table"}), "th": ("td th", {"tr", "table"}), "option": ("option", {"select"})}
DROP = frozenset("head script style noscript template nav aside footer form button select input textarea iframe svg canvas object dialog menu".split())
DROP_ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
DROP_NAMES = frozenset(
    "ad ads advert adverts advertisement adsense advertorial sponsor sponsored promo promotion banner sidebar sidebars menu nav navbar navigation breadcrumb breadcrumbs cookie cookies consent gdpr notice newsletter subscribe subscription signup login popup modal overlay alert topbar share sharing social related recommended footer masthead toolbar widget disqus comment comments reply replies respond pagination pager skip".split()
)
DROP_STEMS = ("comment", "cookie", "advert", "sidebar", "breadcrumb", "newsletter", "sponsor", "promo", "navigat", "subscri", "disqus", "footer", "recommend")
#: Of an <article> only these say that it isn't the page's own; and a header with one of the latter is the article's.
NOT_ITS_OWN = ("comment", "repl", "related", "recommend", "teaser", "sidebar", "promo")
OWN_HEADER = frozenset("article post entry story content section title".split())
#: What is no text of the page, whatever its density.
NEVER = frozenset("head script style noscript template iframe svg canvas button select input textarea".split())
#: Elements that may hold the page's text after all: the first have only their controls dropped where they hold its article, main part or title.
FORMS = frozenset("form object".split())
CONTAINERS = FORMS | frozenset("aside dialog menu".split())
#: Before a name of DROP_NAMES these say what an element has or hasn't, not what it is. Comments are dropped however long they are.
HAVING = frozenset("no with has without hide show".split())
COMMENTS = ("comment", "repl", "respond", "disqus")
#: What is dropped only by such a tag or name comes back if it has more than this share of its own and all kept text outside links:
#: forms and what has something by name, and all others.
SHARE, SHARE_NAMED = 0.5, 0.9
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())

#: A tag whose last quote is never closed ends at the next >.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<[!?][^>]*(?:>|$)|<(/?)([a-zA-Z][^\s/>]*)(?:((?:[^>\"']|\"[^\"]*\"|'[^']*')*)(?:>|$)|([^>]*)(?:>|$))", re.S)
_ATTR = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
_NAME = re.compile(r"[a-z]+|[A-Z][a-z]*")


class Node:
    """An element. parts: texts, child elements, and None where an inline element such as br parts words."""

    __slots__ = ("tag", "attrs", "parent", "parts", "paragraph", "chars", "tags", "link_chars", "links", "density", "total")

    def __init__(self, tag: str, attrs: str = "", parent: Node | None = None):
        self.tag, self.attrs, self.parent, self.parts = tag, attrs, parent, []
        self.paragraph = self if tag == "p" else None if parent is None or tag in KEEPS_P else parent.paragraph  # the open p around
        self.chars = self.tags = self.link_chars = self.links = 0
        self.density = self.total = 0.0


def parse(page: str) -> Node:
    """A tree of the page's elements, unclosed ones ending where HTML has them end. Never fails."""
    root = here = Node("html")
    at = 0
    find = _TOKEN.search
    while m := find(page, at):
        if m.start() > at:
            here.parts.append(html.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag or tag == "html":
            continue
        if m[1]:
            node = here
            while node is not None and node.tag != tag:
                node = node.parent
            if node is not None and node.parent is not None:
                here = node.parent
            continue
        if tag in CLOSES_P and here.paragraph is not None:
            here = here.paragraph.parent
        if tag in SIBLING:
            names, inside = SIBLING[tag]
            here = _close(here, set(names.split()), inside)
        node = Node(tag, m[3] or m[4] or "", here)
        here.parts.append(node)
        if tag in RAW:
            end = re.compile(rf"</{tag}[\s/>]", re.I).search(page, at)
            if end and tag in ("title", "textarea"):
                node.parts.append(html.unescape(page[at : end.start()]))
            close = page.find(">", end.start()) if end else -1
            at = close + 1 if close >= 0 else len(page)
        elif tag not in VOID and not (m[3] or m[4] or "").endswith("/"):
            here = node
    if at < len(page):
        here.parts.append(html.unescape(page[at:]))
    return root


def _close(here: Node, names: set[str], stop: set[str]) -> Node:
    """The place to go on from when the nearest open element of these names ends, unless one of `stop` stands before it."""
    node = here
    while node.parent is not None and node.tag not in stop:
        if node.tag in names:
            return node.parent
        node = node.parent
    return here


def _in_article(node: Node) -> bool:
    up = node.parent
    while up is not None and up.tag not in ("article", "main"):
        up = up.parent
    return up is not None


def _named(words: list[str], node: Node) -> float:
    """As _dropped, by the names of a class or id alone."""
    worst = 0.0
    for at, w in enumerate(words):
        if w in DROP_NAMES or w.startswith(DROP_STEMS) or w == "header" and not OWN_HEADER & set(words) and not _in_article(node):
            if at and words[at - 1] in HAVING:
                worst = max(worst, SHARE)
            elif w.startswith(COMMENTS):
                return 2.0
            else:
                worst = max(worst, SHARE_NAMED)
    return worst


def _hidden(node: Node) -> bool:
    attrs = {name.lower(): value.strip("\"'").lower() for name, value in _ATTR.findall(node.attrs)}
    return "hidden" in attrs or attrs.get("aria-hidden") == "true" or re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", attrs.get("style", "")) is not None


def _dropped(node: Node, holds: bool) -> float:
    """What share of the page's text saves an element that isn't the article's: 2 if none does, 0 if it stays anyhow.

    holds: the page's article, main part or title stands in it, so names and forms don't count."""
    worst = 0.0
    if node.tag in CONTAINERS:
        worst = 0.0 if holds and node.tag in FORMS else SHARE if node.tag in FORMS else SHARE_NAMED
    elif node.tag in DROP:
        return 2.0
    if node.tag == "header":
        return 0.0 if _in_article(node) else 2.0
    if not node.attrs or node.tag in ("body", "main"):
        return worst
    for name, value in _ATTR.findall(node.attrs):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id") and not holds:
            words = [w.lower() for w in _NAME.findall(value)]
            if node.tag == "article":
                if any(w.startswith(NOT_ITS_OWN) for w in words):
                    return 2.0
            else:
                worst = max(worst, _named(words, node))
        if name == "role" and value.lower() in DROP_ROLES and not holds:
            worst = max(worst, SHARE if value.lower() == "form" else 2.0)
    if _hidden(node):
        return 2.0
    return worst


def _marked(root: Node) -> dict[int, float]:
    """By id the elements that tags, roles and names say are not the article's, innermost first, so that a comment's <article> doesn't save the list of comments.

    Without an <article> or <main> that stays, elements marked only by form or name are cleared where they have most of the text."""
    order, todo = [], [(root, False, False)]
    linked: set[int] = set()
    labels: set[int] = set()
    while todo:
        n, link, form = todo.pop()
        order.append(n)
        link, form = link or n.tag == "a", form or n.tag == "form"
        if link:
            linked.add(id(n))
        if form and n.tag in ("label", "legend"):
            labels.add(id(n))
        todo.extend((p, link, form) for p in n.parts if isinstance(p, Node))
    holds: set[int] = set()
    gone: dict[int, float] = {}
    chars: dict[int, int] = {}
    for n in reversed(order):
        chars[id(n)] = 0 if id(n) in linked else sum(len("".join(p.split())) for p in n.parts if isinstance(p, str))
        for p in n.parts:
            if isinstance(p, Node) and id(p) not in gone:
                chars[id(n)] += chars[id(p)]
                if p.tag in ("article", "main", "h1") or id(p) in holds:
                    holds.add(id(n))
        share = 2.0 if id(n) in labels else _dropped(n, id(n) in holds and n.tag != "article")
        if share:
            gone[id(n)] = share
    _bring_back(order, gone, chars)
    return gone


def _without(root: Node, cut) -> None:
    """Take out the elements that cut() says."""
    todo = [root]
    while todo:
        n = todo.pop()
        n.parts = [p for p in n.parts if not isinstance(p, Node) or not cut(p)]
        todo.extend(p for p in n.parts if isinstance(p, Node))


def _bring_back(order: list[Node], gone: dict[int, float], chars: dict[int, int]) -> None:
    """Take out of gone what has the share of text that saves it, lower shares first, and what it stands in."""
    bars: dict[int, float] = {}  # under what is gone: the largest share asked for on the way down
    away: list[Node] = []
    for n in order:
        bar = max(gone.get(id(n), 0.0), bars.get(id(n.parent), 0.0))
        if bar:
            bars[id(n)] = bar
        elif n.tag in ("article", "main") and chars[id(n)]:
            return
        if id(n) in gone and bar <= 1:
            away.append(n)
    kept = chars[id(order[0])]
    for n in sorted(away, key=lambda n: (bars[id(n)], -chars[id(n)])):
        if id(n) not in gone or chars[id(n)] <= bars[id(n)] * (kept + chars[id(n)]):
            continue
        up: Node | None = n
        while up is not None:
            if gone.pop(id(up), None):
                kept += chars[id(up)]
            up = up.parent


def _measure(root: Node) -> list[Node]:
    """Set characters, tags, link characters and links under every node; returns block nodes, parents first."""
    order, todo = [], [(root, False)]
    while todo:
        node, linked = todo.pop()
        linked = linked or node.tag == "a"
        order.append(node)
        node.chars = sum(len("".join(p.split())) for p in node.parts if isinstance(p, str))
        node.link_chars = node.chars if linked else 0
        node.links = int(node.tag == "a")
        node.tags = int(node.tag in BLOCK or node.tag == "a")
        todo.extend((p, linked) for p in node.parts if isinstance(p, Node))
    for node in reversed(order[1:]):
        up = node.parent
        up.chars, up.link_chars, up.links, up.tags = up.chars + node.chars, up.link_chars + node.link_chars, up.links + node.links, up.tags + node.tags
    return [n for n in order if n.tag in BLOCK]


def _density(chars: int, tags: int, link_chars: int, links: int, body: Node) -> float:
    """Characters per tag, scaled by how little of them is in links, with the page's own link share in the logarithm's base."""
    if not chars:
        return 0.0
    tags, lc, other, lt = max(1, tags), max(1, link_chars), max(1, chars - link_chars), max(1, links)
    base = math.log(chars / other * link_chars + body.link_chars / max(1, body.chars) * chars + math.e)
    return chars / tags * math.log(max(1.0, chars / lc * tags / lt) + (math.e - 1), base + 1e-9 if base > 1 else math.e)


def _blocks(nodes: list) -> list[str]:
    """Texts of blocks in page order, white space within each made one space."""
    out: list[str] = []
    run: list[str] = []

    def end() -> None:
        text = " ".join("".join(run).split())
        run.clear()
        if text:
            out.append(text)

    todo: list = list(reversed(nodes))
    while todo:
        p = todo.pop()
        if isinstance(p, str):
            run.append(p)
        elif p is None:
            end()
        elif p.tag in BLOCK:
            end()
            todo.append(None)
            todo.extend(reversed(p.parts))
        else:
            if p.tag in VOID:
                run.append(" ")
            todo.extend(reversed(p.parts))
    end()
    return out


def extract(page: str | None) -> str:
    """The page's main text: blocks joined by line feeds; empty where there is none.

    Densities are those of the page without what never is text (scripts, controls, hidden elements); its menus, notices and comments count.
    Of the blocks that aren't marked as such by tag, role or name, the one with the largest sum of its children's densities is the
    article's, with the <article> or <main> around it. Else the lowest density on the path from it to the body is the threshold by which
    blocks beside that path belong to the article too. Marks have no other say but within what density has chosen."""
    if not page:
        return ""
    root = parse(page)
    gone = _marked(root)
    _without(root, lambda n: n.tag in NEVER or id(n) in gone and _hidden(n))
    blocks = _measure(root)
    body = next((n for n in blocks if n.tag == "body"), root)
    if not root.chars:
        return ""
    for n in blocks:
        n.density = _density(n.chars, n.tags - (n.tag in BLOCK), n.link_chars, n.links, body)
    for n in blocks:
        own, todo = 0, list(n.parts)
        while todo:  # children through inline elements; loose text is one child
            p = todo.pop()
            if isinstance(p, str):
                own += len("".join(p.split()))
            elif p.tag in BLOCK:
                n.total += p.density
            else:
                todo.extend(p.parts)
        n.total += _density(own, 1, 0, 0, body) if own and n.link_chars * 2 <= n.chars else 0.0
    out: set[int] = set()  # what stands in marked elements; blocks come parents first, inline elements among them don't
    order = [root]
    for n in order:
        if id(n) in gone or id(n.parent) in out:
            out.add(id(n))
        order.extend(p for p in n.parts if isinstance(p, Node))
    best = max((n for n in blocks if id(n) not in out), key=lambda n: n.total, default=None)
    if best is None:
        return ""
    path, n = [], best
    while n is not None:
        path.append(n)
        n = n.parent
    threshold = min(n.density for n in path if n.tag in BLOCK and n.density > 0) if best.density > 0 else 0.0
    whole = next((n for n in path[::-1] if n.tag in ("article", "main")), best)
    _without(root, lambda n: id(n) in gone)
    if whole is not best or whole.tag in ("article", "main"):
        return "\n".join(_blocks([whole]))
    on_path = set(map(id, path))
    taken: list = []

    todo: list = [best if best is root else root]
    while todo:
        p = todo.pop()
        if p is best:
            taken.append(p)
        elif isinstance(p, tuple):  # loose text beside the path
            if len(p[0].strip()) >= threshold:
                taken.extend((p[0], None))
        elif id(p) in on_path:
            todo.extend((q,) if isinstance(q, str) else q for q in reversed(p.parts))
        elif p.density >= threshold and p.tag in BLOCK and p.link_chars * 2 <= p.chars or p.tag in HEADINGS and p.parent is best.parent:
            taken.append(p)
    return "\n".join(_blocks(taken))


def main_text(pages: DataFrame, column: str = "html") -> DataFrame:
    """pages with text (the main text) and n_chars (its code points); the html itself is left out.

    A null page has an empty text. Keeps all rows and other columns; columns with the added names are replaced."""
    kept = [c for c in pages.columns if c not in ("text", "n_chars", column)]
    schema = pages.select(*kept).schema.add("text", "string").add("n_chars", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [extract(p.as_py()) for p in batch.column(column)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], names=[*kept, "text", "n_chars"])

    return pages.select(*kept, column).mapInArrow(run, schema)
