"""Operator 8: the main text of web pages, from flat text blocks and a decision tree.

A page becomes a flat list of text blocks. Each block knows its words and link density, those of
the blocks before and after it, and whether it stands inside an article or inside page furniture
(menus, footers, adverts, comments and so on). A decision tree trained on the small labelled
table below says which blocks are main text.

Pages are read whole inside the tasks that hold them; nothing is shuffled.

Defined cases: null and empty html give an empty text; unclosed tags, comments and scripts run
to the end of the page; a reference cut off at the end stays as it is; repeated rows are
extracted each; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from tidewire.llm.common import small_batches

# Kinds of HTML elements.
BLOCK_TAGS = frozenset(
    [
        "address", "article", "aside", "blockquote", "body", "caption", "center", "dd", "details",
        "dialog", "dir", "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form",
        "frameset", "h1", "h2", "h3", "h4", "h5", "h6", "head", "header", "hgroup", "hr", "html",
        "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search", "section",
        "summary", "table", "tbody", "td", "tfoot", "th", "thead", "title", "tr", "ul",
    ])
SILENT_TAGS = frozenset(
    [
        "script", "style", "noscript", "template", "head", "title", "svg", "math", "iframe",
        "object", "canvas", "select", "button", "textarea", "datalist", "audio", "video", "map",
    ])
VOID_TAGS = frozenset([
    "area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track",
    "wbr",
])
FURNITURE_TAGS = frozenset(["nav", "aside", "form", "menu", "dialog", "footer", "header", "search"])
FURNITURE_NAMES = frozenset(
    [
        "ad", "ads", "adv", "advert", "adverts", "advertisement", "banner", "breadcrumb",
        "breadcrumbs", "byline", "comment", "comments", "consent", "cookie", "cookies", "disqus",
        "footer", "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation",
        "newsletter", "notice", "notices", "pagination", "popup", "promo", "promoted", "related",
        "replies", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor",
        "sponsored", "subscribe", "subscription", "tags", "teaser", "toolbar", "widget",
    ])

# A quote that is never closed is an ordinary character, and a tag that is never closed runs to the end
# of the page: every "<" with a name matches, so a page is passed over once.
_ATTRIBUTES = r"(?:[^>\"']|\"[^\"]*\"|'[^']*'|[\"'])*"
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*(?:>|\Z)"
    rf"|<(script|style|textarea|title)(?=[\s/>])(?:{_ATTRIBUTES})(?:>|\Z).*?(?:</\1\s*>|\Z)"
    rf"|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})(?:>|\Z)", re.S | re.I)
_NAMES = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"\bhidden\b(?!\s*=\s*[\"']?until)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.I)
_VALUES = re.compile(r"\"[^\"]*\"|'[^']*'")

NEUTRAL_NAMES = frozenset(
    [
        "area", "bar", "block", "body", "bottom", "box", "button", "buttons", "container", "global", "icons",
        "inner", "item", "left", "link", "links", "list", "right", "section", "site", "slot", "top", "unit",
    ])
COMMENT_NAMES = frozenset(["comment", "comments", "disqus", "replies", "respond"])
WRAPPER = 0.6  # a named element with a greater share of the page's words is no furniture
ARTICLE = 0.25  # least share of the words outside furniture that makes an article the page's

# One row a block: words, link density in percent, words and density of the block before, the same
# of the block after, inside furniture, place (2: in an article, 1: the page has none, 0: outside it),
# is a heading; main text.
LABELLED = [
    (6, 100, 0, 0, 1, 100, 1, 0, 0, 0), (1, 100, 1, 100, 1, 100, 1, 0, 0, 0), (1, 100, 1, 100, 9, 0, 1, 0, 0, 0),
    (9, 0, 1, 100, 10, 0, 1, 0, 0, 0), (12, 0, 80, 0, 0, 0, 1, 0, 0, 0), (40, 5, 60, 0, 12, 0, 1, 0, 0, 0),
    (55, 0, 12, 0, 30, 0, 1, 1, 0, 0), (3, 0, 8, 0, 60, 0, 1, 2, 1, 0), (25, 10, 60, 0, 70, 0, 1, 2, 0, 0),
    (30, 0, 40, 0, 20, 0, 1, 2, 0, 0), (4, 50, 0, 0, 5, 60, 1, 1, 0, 0), (5, 0, 3, 100, 90, 0, 1, 1, 1, 0),
    (10, 0, 9, 0, 55, 0, 0, 2, 1, 1), (5, 0, 1, 100, 40, 0, 0, 2, 1, 1), (60, 0, 10, 0, 45, 0, 0, 2, 0, 1),
    (45, 4, 60, 0, 30, 0, 0, 2, 0, 1), (2, 0, 45, 0, 3, 0, 0, 2, 0, 1), (3, 0, 2, 0, 12, 0, 0, 2, 0, 1),
    (120, 2, 3, 0, 12, 0, 0, 2, 0, 1), (1, 0, 10, 0, 12, 0, 0, 2, 0, 1), (8, 100, 50, 0, 70, 0, 0, 2, 0, 1),
    (4, 0, 9, 0, 12, 0, 0, 2, 0, 1), (200, 0, 150, 0, 12, 0, 0, 2, 0, 1), (15, 60, 40, 0, 35, 0, 0, 2, 0, 1),
    (3, 0, 1, 100, 9, 0, 0, 0, 0, 0), (20, 0, 80, 0, 5, 0, 0, 0, 0, 0), (50, 0, 70, 0, 0, 0, 0, 0, 0, 0),
    (7, 0, 0, 0, 12, 0, 0, 0, 1, 0), (2, 100, 12, 0, 2, 100, 0, 0, 0, 0), (30, 80, 5, 0, 10, 0, 0, 0, 0, 0),
    (90, 0, 40, 0, 30, 0, 0, 0, 0, 0), (15, 10, 12, 0, 40, 0, 0, 0, 0, 0), (2, 0, 60, 0, 80, 0, 0, 0, 0, 0),
    (9, 0, 30, 0, 25, 0, 0, 0, 1, 0), (35, 5, 45, 0, 60, 0, 0, 0, 0, 0), (11, 0, 5, 0, 14, 0, 0, 0, 0, 0),
    (6, 0, 3, 0, 4, 0, 0, 2, 0, 1), (30, 0, 0, 0, 4, 0, 0, 2, 0, 1), (12, 0, 0, 0, 0, 0, 0, 2, 0, 1),
    (2, 100, 4, 0, 3, 100, 0, 2, 0, 1), (70, 20, 2, 100, 6, 0, 0, 2, 0, 1), (5, 0, 0, 0, 3, 0, 0, 2, 1, 1),
    (60, 0, 10, 0, 45, 0, 0, 1, 0, 1), (25, 4, 60, 0, 30, 0, 0, 1, 0, 1), (110, 0, 20, 0, 80, 0, 0, 1, 0, 1),
    (18, 0, 50, 0, 3, 0, 0, 1, 0, 1), (14, 10, 7, 0, 22, 0, 0, 1, 0, 1), (40, 15, 3, 0, 4, 100, 0, 1, 0, 1),
    (16, 0, 4, 100, 2, 100, 0, 1, 0, 1), (32, 0, 0, 0, 0, 0, 0, 1, 0, 1), (5, 0, 40, 0, 50, 0, 0, 1, 0, 1),
    (3, 0, 35, 0, 28, 0, 0, 1, 1, 1), (9, 0, 25, 0, 33, 0, 0, 1, 0, 1), (8, 0, 3, 100, 60, 0, 0, 1, 1, 1),
    (6, 0, 1, 100, 70, 0, 0, 1, 1, 1), (2, 100, 2, 100, 2, 100, 0, 1, 0, 0), (4, 100, 40, 0, 4, 100, 0, 1, 0, 0),
    (25, 90, 3, 100, 12, 80, 0, 1, 0, 0), (18, 70, 50, 0, 5, 100, 0, 1, 0, 0), (5, 0, 3, 100, 2, 100, 0, 1, 0, 0),
    (6, 0, 50, 0, 2, 100, 0, 1, 0, 0), (3, 0, 2, 100, 5, 0, 0, 1, 0, 0), (4, 0, 5, 0, 0, 0, 0, 1, 0, 0),
    (5, 0, 0, 0, 3, 100, 0, 1, 1, 0), (7, 100, 60, 0, 45, 0, 0, 1, 0, 0), (40, 60, 4, 100, 30, 70, 0, 1, 0, 0),
]


def grown(x: np.ndarray, y: np.ndarray, depth: int = 8) -> tuple | int:
    """A binary decision tree by Gini impurity: (column, bound, at or below, above), or a class."""
    if depth == 0 or len(set(y)) == 1:
        return int(2 * y.sum() >= len(y))
    best = None
    for column in range(x.shape[1]):
        values = np.unique(x[:, column])
        for bound in (values[:-1] + values[1:]) / 2:
            below = x[:, column] <= bound
            cost = sum(2 * len(s) * s.mean() * (1 - s.mean()) for s in (y[below], y[~below]))
            if best is None or cost < best[0] - 1e-12:
                best = cost, column, bound, below
    if best is None:
        return int(2 * y.sum() >= len(y))
    _, column, bound, below = best
    return column, float(bound), grown(x[below], y[below], depth - 1), grown(x[~below], y[~below], depth - 1)


def trained(rows: list[tuple] = LABELLED) -> tuple | int:
    data = np.array(rows, dtype=float)
    return grown(data[:, :-1], data[:, -1])


def is_main(tree: tuple | int, features: tuple) -> bool:
    while not isinstance(tree, int):
        column, bound, below, above = tree
        tree = below if features[column] <= bound else above
    return bool(tree)


def _furniture_name(attributes: str) -> str:
    """The first whole name among class, id and role that stands for furniture: a listed word, or
    several of them joined, also with words that say nothing, such as cookie-notice or site-footer.
    Names that only hold such a word, such as has-sidebar, are none."""
    for found in _NAMES.findall(attributes):
        for name in "".join(found).lower().split():
            parts = [p for p in re.split(r"[-_]+", name) if p]
            if any(p in FURNITURE_NAMES for p in parts) and all(p in FURNITURE_NAMES or p in NEUTRAL_NAMES for p in parts):
                return name
    return ""


def blocks(page: str) -> list[tuple[str, int, float, bool, bool, bool]]:
    """(text, words, link density in percent, in furniture, in article, heading) of each block.

    An element with the name of furniture that holds most of the page's words is a wrapper, not
    furniture, unless its name is of reader comments.
    """
    found, named = _parsed(page)
    total = sum(b[1] for b in found)
    held: dict[int, int] = {}
    for b in found:
        for element in b[6]:
            held[element] = held.get(element, 0) + b[1]
    wrappers = {e for e, n in held.items() if n > WRAPPER * total and not COMMENT_NAMES.intersection(re.split(r"[-_]+", named[e]))}
    return [(text, words, density, plain or any(e not in wrappers for e in elements), article, heading)
            for text, words, density, plain, article, heading, elements in found]


def _parsed(page: str) -> tuple[list[tuple], list[str]]:
    """Blocks with the named elements they stand in, and the names of these elements."""
    out: list[tuple] = []
    names: list[str] = []
    stack: list[tuple] = []  # element, silent, furniture by tag, article, elements with a name of furniture
    inside: tuple[int, ...] = ()
    parts: list[str] = []
    linked: list[str] = []
    links = heading = 0
    silent = furniture = article = False

    def close() -> None:
        nonlocal parts, linked
        if parts:
            text = " ".join(html.unescape("".join(parts)).split())
            if text:
                words = len(text.split(" "))
                n = len(html.unescape("".join(linked)).split()) if linked else 0
                out.append((text, words, min(100.0, 100 * n / words), furniture, article, bool(heading), inside))
            parts, linked = [], []

    at = 0
    for match in _TOKEN.finditer(page):
        if match.start() > at and not silent:
            text = page[at:match.start()]
            parts.append(text)
            if links:
                linked.append(text)
        at = match.end()
        name = match[3]
        if name is None:
            if match[1] and not silent:
                (parts.append(" ") if match[1].lower() == "textarea" else close())
            continue
        name, closing, attributes = name.lower(), match[2], match[4]
        if name in BLOCK_TAGS:
            close()
        elif name == "br" and not silent:
            parts.append(" ")
        if name == "a":
            links = 0 if closing else 1
        elif len(name) == 2 and name[0] == "h" and name[1] in "123456":
            heading = 0 if closing else 1
        if closing:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    close()
                    del stack[k:]
                    break
                if stack[k][0] in ("article", "main", "body") and name not in ("article", "main", "body", "html"):
                    break  # an end tag does not leave the article around it
            _, silent, furniture, article, inside = stack[-1] if stack else ("", False, False, False, ())
        elif name not in VOID_TAGS and not attributes.endswith("/") and name not in ("p", "html"):
            known = name in BLOCK_TAGS or name in SILENT_TAGS
            called = _furniture_name(attributes) if attributes and name not in ("article", "main", "body") else ""
            hides = bool(attributes) and bool(_HIDDEN.search(_VALUES.sub(
                lambda m: m[0] if "none" in m[0] or "true" in m[0] else '""', attributes)))
            if known or called or hides:
                if called:
                    names.append(called)
                # An article in furniture is none: a card of a list, or a reader's comment.
                now = (name, silent or name in SILENT_TAGS or hides,
                       furniture or name in FURNITURE_TAGS and not (name == "header" and article),
                       article or name in ("article", "main") and not (name == "article" and furniture),
                       (*inside, len(names) - 1) if called else inside)
                if now[1:] != (silent, furniture, article, inside):
                    close()
                stack.append(now)
                _, silent, furniture, article, inside = now
    if not silent:
        parts.append(page[at:])
        if links:
            linked.append(page[at:])
    close()
    return out, names


def main_text(page: str | None, tree: tuple | int) -> str:
    """The main text of a page, its blocks joined by line ends in page order."""
    found = blocks(page) if page else []
    # An article counts as the page's if it holds a good part of the words that are not furniture.
    own = sum(b[1] for b in found if b[4] and not b[3])
    some = own > 0 and own >= ARTICLE * sum(b[1] for b in found if not b[3])
    edge = ("", 0, 0.0, False, False, False)
    kept = []
    for i, b in enumerate(found):
        before, after = found[i - 1] if i else edge, found[i + 1] if i + 1 < len(found) else edge
        features = (b[1], b[2], before[1], before[2], after[1], after[2], b[3], (2 if b[4] else 0) if some else 1, b[5])
        if is_main(tree, features):
            kept.append(b[0])
    return "\n".join(kept)


def extracted(pages: DataFrame, labelled: list[tuple] = LABELLED, key: str = "page_id", url: str = "url", page: str = "html") -> DataFrame:
    """(key, url, text): the main text of each whole page."""
    tree = trained(labelled)

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in small_batches(batches, "html"):
            texts = [main_text(p, tree) for p in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("url"), pa.array(texts, pa.string())],
                                             ["key", "url", "text"])

    source = pages.select(F.col(key).alias("key"), F.col(url).alias("url"), F.col(page).alias("html"))
    schema = T.StructType([*source.schema.fields[:2], T.StructField("text", T.StringType())])
    return source.mapInArrow(extract, schema).withColumnsRenamed({"key": key, "url": url})
