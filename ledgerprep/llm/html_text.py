"""Operator 6, main text of web pages by composite text density.

For every node of a page: characters per tag below it, weighed by the share of its characters
that are links. A node's sum is that of its children's densities. The node of the largest sum
sets the threshold, the smallest density on its path to the body; every node at or above it gives
the subtree of the largest sum in it. The text is that of the smallest node that holds all these,
or of the article or main element around it, so that no paragraph between them is lost.

Parts that are never an article do not count and are not returned: by element (menus, headers,
footers, asides, scripts, styles and the like) and hidden ones. Forms, and elements with a word of
class, id or role that names adverts, notices, comments and the like, are left out too, unless they
hold an article or main element, the node of the largest sum, or more text than is outside of all
of them (and a quarter of the largest): then they, and others of the same name, are layout. A name that is all of such words
(``comments``, ``ad-banner``) is judged by that only if there is no text outside. Names of states
(``has-sidebar``), ids of headings and paragraphs, and ids of sections with other words do not count.

Cases: a null or empty page, and one without text, gives an empty text; a page that breaks off is
read to its end, without the tag or comment that is not closed; a stray quote in a tag does not
keep it open, nor does one that is never closed; elements left open end with their
parent or the next of their kind; any nesting depth is read without recursion; each row gives one
row.
"""

from __future__ import annotations

import html
import math
import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A quote opens only as the first letter of a value and if it is closed; elsewhere a tag ends at the next ">".
_TAG = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*+)((?:[\s/]++|[^\s/>][^\s/>=]*+(?:\s*+=\s*+(?:"[^"]*"|'[^']*'|[^\s>"'][^\s>]*+)?)?)*+)>"""
    r"""|<(?:[!?]|/[^a-zA-Z>])[^>]*>|</>""",
    re.DOTALL,
)
_BROKEN = re.compile(r"<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)>")
_OPEN = re.compile(r"<[a-zA-Z/!?]")
_ATTRIBUTE = re.compile(r"""\b(class|id|role)\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))""", re.IGNORECASE)
_HIDDEN = re.compile(r"""(?:^|\s)(?:hidden(?=\s|=|/|$)|aria-hidden\s*=\s*["']?true)""", re.IGNORECASE)
_PART = re.compile(r"[^a-z0-9]+")

_RAW = frozenset("script style textarea title noscript template iframe xmp noembed noframes".split())
_EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form"
    " h1 h2 h3 h4 h5 h6 header hr html li main menu nav ol p pre section summary table tbody tfoot thead tr ul".split()
)
#: What opens anew ends an open element of these kinds, unless one of the others stands between.
_ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "option": ({"option"}, {"select"}),
}
_SCOPE = frozenset("table td th button object caption".split())
_NEVER = frozenset(
    "nav header footer aside script style noscript template iframe svg canvas button select textarea input dialog menu"
    " object embed audio video head title".split()
)
_NEVER_NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertisements advertising adsense banner breadcrumb breadcrumbs comment comments"
    " commentlist consent cookie cookies disqus disclaimer footer gdpr header masthead menu modal nav navbar navigation newsletter notice"
    " notices pagination popup promo promoted promotion related replies reply respond search share sharing sidebar signup"
    " social sponsor sponsored subscribe toolbar widget".split()
)
_NEVER_ROLE = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar toolbar".split())
#: Of the words above, those that wrap a page as often as they name a part of it.
_LAYOUT = frozenset(
    "banner header masthead menu modal nav navbar navigation footer respond search share sharing sidebar social toolbar widget notice"
    " notices".split()
)
_GENERIC = frozenset("area block box items list posts section thread".split())
_STATE = frozenset(
    "has no not with without is open opened closed enabled disabled active inactive visible collapsed expanded on off".split()
)
_HEADING_OR_PARAGRAPH = frozenset("h1 h2 h3 h4 h5 h6 p".split())


def _never(tag: str, attributes: str) -> bool:
    if tag in _NEVER:
        return True
    if not attributes or tag in ("body", "html", "article", "main"):
        return False
    return _HIDDEN.search(attributes) is not None


def _suspect(tag: str, attributes: str) -> tuple[bool, frozenset[str]] | None:
    """Whether an element that may be no article is named by words of that kind only, and its names."""
    whole, names = False, ["form"] if tag == "form" else []
    if attributes and tag not in ("body", "html"):
        for attribute, *values in _ATTRIBUTE.findall(attributes):
            attribute, value = attribute.lower(), "".join(values).lower()
            if attribute == "role":
                if value.strip() in _NEVER_ROLE:
                    names.append(f"role {value.strip()}")
                continue
            if attribute == "id" and tag in _HEADING_OR_PARAGRAPH:
                continue
            for token in value.split():
                parts = {part for part in _PART.split(token) if part}
                if _NEVER_NAMED.isdisjoint(parts) or not _STATE.isdisjoint(parts):
                    continue
                only = parts <= _NEVER_NAMED | _GENERIC
                if attribute == "id" and tag == "section" and not only:
                    continue
                whole |= only and not parts <= _LAYOUT | _GENERIC
                names.append(token)
    return (whole, frozenset(names)) if names else None


class _Page:
    """Nodes in page order; ``stop[i]`` is the first node after the subtree of node i."""

    def __init__(self, page: str):
        self.tag, self.parent, self.stop = ["html"], [-1], [0]
        self.pieces: list[tuple[int, str | None]] = []  # node and text; no text: a block begins or ends
        open_, skipped, at, links = [0], 0, 0, 0
        self.link: list[bool] = [False]
        self.suspects: dict[int, tuple[bool, frozenset[str]]] = {}
        end = len(page)
        while at < end:
            mark = _OPEN.search(page, at)
            begin = mark.start() if mark else end
            tag = _TAG.match(page, begin) or _BROKEN.match(page, begin)  # none: the page breaks off in it
            if begin > at and not skipped:
                self.pieces.append((open_[-1], page[at:begin]))
            if tag is None:
                break
            at = tag.end()
            name = tag[2]
            if not name:
                continue
            name = name.lower()
            if tag[1]:
                if name in self._names(open_):
                    while True:
                        node = open_.pop()
                        skipped -= node < 0
                        closed = self._close(node, name if node < 0 else None)
                        if closed == name:
                            break
                    if not open_:
                        open_ = [0]
                elif name == "p" and not skipped:
                    self.pieces.append((open_[-1], None))
                if name in _BLOCK and not skipped:
                    self.pieces.append((open_[-1], None))
                continue
            if name in _BLOCK:
                self._end(open_, {"p"}, _SCOPE)
            if name in _ENDS:
                self._end(open_, *_ENDS[name])
            skipped = sum(1 for n in open_ if n < 0)
            attributes = tag[3]
            if name in ("html", "body") and (name == "html" or "body" in self.tag):
                continue
            if name in _RAW:
                close = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.IGNORECASE).search(page, at)
                at = close.end() if close else end
                continue
            if name in _EMPTY or attributes.endswith("/") and name not in _BLOCK:
                if not skipped:
                    self.pieces.append((open_[-1], None) if name in _BLOCK else (open_[-1], " "))
                continue
            if skipped or _never(name, attributes):
                self._skip.append(name)
                open_.append(-len(self._skip))
                skipped += 1
                if skipped == 1 and name in _BLOCK:
                    self.pieces.append((next(n for n in reversed(open_) if n >= 0), None))
                continue
            self.tag.append(name)
            self.parent.append(open_[-1])
            self.stop.append(0)
            self.link.append(name == "a" or self.link[open_[-1]])
            open_.append(len(self.tag) - 1)
            suspect = _suspect(name, attributes)
            if suspect:
                self.suspects[open_[-1]] = suspect
            if name in _BLOCK:
                self.pieces.append((open_[-1], None))
            elif name in ("td", "th"):
                self.pieces.append((open_[-1], " "))
        while open_:
            self._close(open_.pop(), None)
        self.stop[0] = len(self.tag)

    @property
    def _skip(self) -> list[str]:
        if not hasattr(self, "_skipped"):
            self._skipped: list[str] = []
        return self._skipped

    def _name(self, node: int) -> str:
        return self.tag[node] if node >= 0 else self._skip[-node - 1]

    def _names(self, open_: list[int]) -> set[str]:
        return {self._name(n) for n in open_[1:]}

    def _close(self, node: int, _name: str | None) -> str:
        if node >= 0:
            self.stop[node] = len(self.tag)
        return self._name(node)

    def _end(self, open_: list[int], kinds: set[str], scope: frozenset | set) -> None:
        for depth in range(len(open_) - 1, 0, -1):
            name = self._name(open_[depth])
            if name in kinds:
                while len(open_) > depth:
                    self._close(open_.pop(), None)
                if open_[-1] >= 0:
                    self.pieces.append((open_[-1], None))
                return
            if name in scope or name in _BLOCK and "p" in kinds:
                return


def _densities(page: _Page, sizes: list[int], out: list[int]) -> tuple[list[int], list[float], list[float]]:
    """Characters, density and sum of the children's densities of every node; those of ``out`` do not count."""
    n = len(page.tag)
    chars = [0 if cut else size for size, cut in zip(sizes, out, strict=True)]
    tags = [int(not cut) for cut in out]
    link_chars = [size if link else 0 for size, link in zip(chars, page.link, strict=True)]
    link_tags = [int(tag == "a" and not cut) for tag, cut in zip(page.tag, out, strict=True)]
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        chars[up] += chars[i]
        tags[up] += tags[i]
        link_chars[up] += link_chars[i]
        link_tags[up] += link_tags[i]
    body = _body(page)
    ratio = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n - 1, -1, -1):
        c, lc = chars[i], link_chars[i]
        if c:
            base = math.log(c / max(1, c - lc) * lc + ratio * c + math.e)
            density[i] = c / tags[i] * math.log(max(1.0, c / max(1, lc) * tags[i] / max(1, link_tags[i])) + 1) / max(1.0, math.log(base + 1))
        if i:
            total[page.parent[i]] += density[i]
    return chars, density, total


def _body(page: _Page) -> int:
    return page.tag.index("body") if "body" in page.tag else 0


def _within(page: _Page, nodes: set[int]) -> list[int]:
    """By node, the outermost of ``nodes`` that it is or lies in, or 0."""
    out = [0] * len(page.tag)
    for i in range(1, len(out)):
        out[i] = out[page.parent[i]] or (i if i in nodes else 0)
    return out


def _left_out(page: _Page, sizes: list[int]) -> list[int]:
    """By node, the suspect whose subtree it is in and that is no part of an article, or 0."""
    if not page.suspects:
        return [0] * len(page.tag)
    plain = _within(page, {i for i, tag in enumerate(page.tag) if tag in ("label", "legend", "a")})
    plain = [0 if label else size for size, label in zip(sizes, plain, strict=True)]

    def sums(out: list[int]) -> list[int]:
        text = [0 if cut else size for size, cut in zip(plain, out, strict=True)]
        for i in range(len(text) - 1, 0, -1):
            text[page.parent[i]] += text[i]
        return text

    text = sums([0] * len(plain))
    articles = [i for i, tag in enumerate(page.tag) if tag in ("article", "main") and i not in page.suspects and text[i]]
    largest = max(articles, key=lambda i: (text[i], -i), default=0)
    whole = {i for i, (only, _) in page.suspects.items() if only and page.tag[i] not in ("article", "main")}
    whole = {i for i in whole if not i < largest < page.stop[i]}
    out = _within(page, whole)
    text = sums(out)
    if not text[0]:
        whole, out = set(), [0] * len(plain)
        text = sums(out)
    open_ = {i for i in page.suspects if not out[i] and page.tag[i] not in ("article", "main")}
    if not open_:
        return out
    total = _densities(page, sizes, out)[2]
    best = max((i for i in range(len(total)) if not out[i]), key=lambda i: (total[i], -i))
    apart = [text[i] for i in {*_within(page, open_)} - {0}]
    least = max(text[0] - sum(apart) + 1, max(apart) // 4)
    articles = [i for i in articles if not out[i]]
    kept = {
        i for i in open_
        if i <= best < page.stop[i] and text[i] or text[i] >= least
        or bisect_left(articles, page.stop[i]) > bisect_left(articles, i)
    }
    layout = frozenset().union(*(page.suspects[i][1] for i in kept)) - {"form"}
    kept |= {i for i in open_ if page.suspects[i][1] <= layout}
    return _within(page, whole | open_ - kept)


def _root(page: _Page, sizes: list[int], out: list[int]) -> int:
    """The node whose text is the main text."""
    n, body = len(page.tag), _body(page)
    chars, density, total = _densities(page, sizes, out)
    best = max(range(n), key=lambda i: (total[i], -i))
    threshold, node = density[best], best
    while node > 0:
        threshold = min(threshold, density[node])
        if node == body:
            break
        node = page.parent[node]
    # The largest sum in each subtree, and where.
    top = list(range(n))
    for i in range(n - 1, 0, -1):
        up = page.parent[i]
        if total[top[i]] > total[top[up]]:
            top[up] = top[i]
    marked, at = [], body
    while at < page.stop[body]:
        if density[at] >= threshold and chars[at]:
            found = top[at]
            marked.append(found)
            at = page.stop[at] if found == at else at + 1
        else:
            at += 1
    root = _common(page, marked or [best])
    up = root
    while up > 0:
        if page.tag[up] in ("article", "main"):
            root = up
        up = page.parent[up]
    return root


def _common(page: _Page, nodes: list[int]) -> int:
    first, last, root = min(nodes), max(nodes), min(nodes)
    while root > 0 and not (root <= first and last < page.stop[root]):
        root = page.parent[root]
    return root


def main_text(page: str | None) -> str:
    """The article of one page: blocks in page order, joined by two line ends."""
    if not page:
        return ""
    nodes = _Page(page)
    sizes = [0] * len(nodes.tag)
    texts = [(node, None if text is None else html.unescape(text)) for node, text in nodes.pieces]
    for node, text in texts:
        if text:
            sizes[node] += len(text) if not text.isspace() else 0
    out = _left_out(nodes, sizes)
    root = _root(nodes, sizes, out)
    blocks: list[str] = []
    held: list[str] = []
    for node, text in texts:
        cut = out[node]
        if cut and (text is not None or node != cut or nodes.tag[cut] not in _BLOCK):
            continue
        if text is None:
            blocks.append("".join(held))
            held = []
        elif root <= node < nodes.stop[root]:
            held.append(text)
    blocks.append("".join(held))
    return "\n\n".join(b for b in (" ".join(x.split()) for x in blocks) if b)


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(page.as_py()) for page in batch.column("html")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())], names=["page_id", "url", "text"]
            )

    picked = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    kind = {f.name: f.dataType.simpleString() for f in picked.schema}
    return picked.mapInArrow(run, f"page_id {kind['page_id']}, url {kind['url']}, text string")
