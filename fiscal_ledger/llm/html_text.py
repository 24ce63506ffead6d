"""Main text of web pages by tree scoring.

A page is read into a tree of its block elements. Inline text between two block boundaries is one
block of text. Each block passes points for its length and commas to the elements above it, whole to the first, half
to the second and a third of that at each further step; an element's points are discounted by the share of its text that is
links. The element with most points is the container. It grows to the ``article`` or ``main`` around it, and
siblings that score or read like it are kept too.

Menus, headers, footers, sidebars, notices, adverts, forms, reader comments, scripts and styles are known
by element, role, class and id and take no part. Headings never go by class or id. Within ``article`` and ``main`` words that
also name parts or topics of an article (``article-header``, ``market-share``) tell nothing by themselves: such an element
goes if it is mostly links, or if the word is its whole class or id and it holds no heading, paragraph or table.
Reading and scoring take time linear in the page, however deep it is nested. A null or empty page gives empty text. Rows come
out one for one, so ties, repeated rows and ids stay; an empty table gives an empty table; columns other than
page_id, url and html are dropped, so their names cannot clash. Unclosed tags and pages that
break off are read as far as they go.
"""

from __future__ import annotations

import html as entities
import re
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fiscal_ledger.llm.memory import releasing

# Elements of the HTML standard by how they are treated.
RAW = {"script", "style", "textarea", "title", "noscript", "iframe", "xmp", "template", "noembed", "noframes", "svg", "math"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "button", "caption", "center", "dd", "details", "dialog",
    "div", "dl", "dt", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6",
    "head", "header", "hgroup", "html", "legend", "li", "main", "menu", "nav", "ol", "option", "p", "pre", "search",
    "section", "select", "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
PARAGRAPHS = {"p", "pre", "td", "th", "li", "dd", "dt", "blockquote", "h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
# An opening tag ends open elements of these names, as far as only elements of paragraphs are between.
ENDS = {
    "li": {"li"},
    "dt": {"dt", "dd"},
    "dd": {"dt", "dd"},
    "tr": {"tr", "td", "th"},
    "td": {"td", "th"},
    "th": {"td", "th"},
    "option": {"option"},
    "tbody": {"thead", "tbody", "tr", "td", "th"},
    "tfoot": {"thead", "tbody", "tr", "td", "th"},
}
# Elements, roles and words of class names that mark what is not the article.
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "menu", "dialog", "fieldset", "head", "search", "option"}
DROPPED_ROLES = {
    "navigation", "banner", "contentinfo", "complementary", "search", "dialog", "alert", "alertdialog", "form", "menu",
    "menubar", "toolbar",
}
DROPPED_WORDS = {
    "ad", "ads", "adsense", "advert", "adverts", "advertisement", "advertising", "alert", "aside", "banner",
    "breadcrumb", "breadcrumbs", "comment", "comments", "consent", "cookie", "cookies", "discussion", "disqus", "footer",
    "gdpr", "header", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter", "notice", "notices",
    "overlay", "pager", "pagination", "popup", "promo", "promotion", "promoted", "recommended", "related", "replies",
    "reply", "respond", "share", "sharing", "sidebar", "signup", "social", "sponsor", "sponsored", "subscribe",
    "subscription", "toolbar", "widget",
}
# Those of them that parts of an article are named by too.
AMBIGUOUS_WORDS = {
    "discussion", "footer", "header", "promotion", "recommended", "related", "replies", "reply", "respond", "share",
    "sharing", "social", "subscription",
}
WHOLE = {"html", "body", "article", "main"}
ARTICLES = {"article", "main"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE = PARAGRAPHS | {"table", "article", "main"}

# How an element is taken up: as it is, as a suspect to be judged by its content, or not at all.
KEPT, SUSPECT, SUSPECT_BY_NAME, GONE = range(4)

# Characters from which a block counts as a paragraph, and the points its length can earn.
LONG = 25
MOST_LENGTH_POINTS = 3

_TOKEN = re.compile(
    r"<(?:!--(?:.*?-->|.*)|(/?)([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*+)>?|[!?/][^>]*>?)", re.S
)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_NOT_SHOWN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
_SPACE = re.compile(r"\s+")


def _treatment(name: str, attributes: str, in_article: bool) -> int:
    if name in DROPPED or (name == "header" and not in_article):
        return GONE
    if not attributes or name in WHOLE:
        return KEPT
    found = KEPT
    for key, *values in _ATTRIBUTE.findall(attributes):
        key, value = key.lower(), "".join(values)
        if key in ("class", "id"):
            if name not in HEADINGS:
                found = max(found, *(_by_label(label, in_article) for label in value.lower().split()), KEPT)
        elif key == "role":
            if value.lower() in DROPPED_ROLES:
                return GONE
        elif key == "hidden" or (key == "aria-hidden" and value.lower() == "true"):
            return GONE
        elif key == "style" and _NOT_SHOWN.search(value):
            return GONE
    return found


def _by_label(label: str, in_article: bool) -> int:
    """What one class or id says about an element."""
    parts = re.split(r"[-_]+", label)
    words = {parts[0], parts[-1]} & DROPPED_WORDS
    if not words or {"with", "has", "no"} & set(parts):
        return KEPT
    if not in_article or words - AMBIGUOUS_WORDS:
        return GONE
    return SUSPECT_BY_NAME if len(parts) == 1 else SUSPECT


class _Tree:
    """The block elements of a page and its blocks of text."""

    def __init__(self, page: str):
        self.names, self.parents, self.treated, self.in_article = ["#page"], [-1], [KEPT], [False]
        self.blocks: list[tuple[int, str, int]] = []  # element, text, characters of it inside links
        self._open, self._parts, self._links, self._in_link = [0], [], 0, False
        # Depths at which elements of a name, and any that no paragraph's end reaches through, are open.
        self._depths: defaultdict[str, list[int]] = defaultdict(list)
        self._walls = [0]
        at, end = 0, len(page)
        while at < end:
            found = _TOKEN.search(page, at)
            if found is None:
                self._text(page[at:])
                break
            if found.start() > at:
                self._text(page[at : found.start()])
            at = found.end()
            name = found[2]
            if name is None:
                continue
            name = name.lower()
            if found[1]:
                self._close(name)
            elif name in RAW:
                if not found[3].endswith("/") or name not in ("svg", "math"):
                    closing = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
                    at = closing.end() if closing else end
            else:
                self._start(name, found[3])
        self._flush()

    def _text(self, raw: str) -> None:
        text = entities.unescape(raw) if "&" in raw else raw
        self._parts.append(text)
        if self._in_link:
            self._links += len(text)

    def _flush(self) -> None:
        if self._parts:
            element = self._open[-1]
            if self.treated[element] != GONE:
                text = _SPACE.sub(" ", "".join(self._parts)).strip()
                if text:
                    self.blocks.append((element, text, min(self._links, len(text))))
            self._parts = []
        self._links = 0

    def _start(self, name: str, attributes: str) -> None:
        if name == "br":
            self._parts.append(" ")
        elif name == "a":
            self._in_link = True
        elif name in BLOCKS or (name == "hr"):
            self._flush()
            self._in_link = False
            self._end_implied(name)
            if name != "hr":
                self._push(name, _treatment(name, attributes, self.in_article[self._open[-1]]))
        elif name not in VOID and not attributes.endswith("/"):
            if _treatment(name, attributes, self.in_article[self._open[-1]]) == GONE:
                # An inline element, span for one, that is an advert or hidden is an element of its own.
                self._flush()
                self._push(name, GONE)

    def _push(self, name: str, treated: int) -> None:
        above = self._open[-1]
        if name not in PARAGRAPHS:
            self._walls.append(len(self._open))
        self._depths[name].append(len(self._open))
        self._open.append(len(self.names))
        self.names.append(name)
        self.parents.append(above)
        self.treated.append(GONE if self.treated[above] == GONE else treated)
        self.in_article.append(self.in_article[above] or name in ARTICLES)

    def _leave(self, depth: int) -> None:
        """Close all open elements from a depth on."""
        for element in self._open[depth:]:
            self._depths[self.names[element]].pop()
        del self._open[depth:]
        while self._walls[-1] >= depth:
            self._walls.pop()

    def _end_implied(self, name: str) -> None:
        ended = ENDS.get(name, set()) | {"p"}
        wall = next(w for w in reversed(self._walls) if self.names[self._open[w]] not in ended)
        while (depth := max((self._depths[n][-1] for n in ended if self._depths[n]), default=0)) > wall:
            self._leave(depth)

    def _close(self, name: str) -> None:
        if name == "a":
            self._in_link = False
            return
        depths = self._depths[name] if name in self._depths else []
        if name in BLOCKS or depths:
            self._flush()
            # A stray </p> closes nothing further up.
            if depths and (name != "p" or self._walls[-1] < depths[-1]):
                self._leave(depths[-1])


def _sizes(tree: _Tree) -> tuple[list[int], list[int]]:
    """The characters in each element, and those of them in links."""
    length, links = [0] * len(tree.names), [0] * len(tree.names)
    for element, text, linked in tree.blocks:
        length[element] += len(text)
        links[element] += linked
    for element in range(len(tree.names) - 1, 0, -1):
        length[tree.parents[element]] += length[element]
        links[tree.parents[element]] += links[element]
    return length, links


def _judge(tree: _Tree) -> None:
    """Take away the suspects that their content shows not to be part of the article."""
    length, links = _sizes(tree)
    prose = [False] * len(tree.names)
    for element in range(len(tree.names) - 1, 0, -1):
        prose[element] = prose[element] or (tree.names[element] in PROSE and length[element] > 0)
        if prose[element]:
            prose[tree.parents[element]] = True
    for element in range(1, len(tree.names)):
        treated = tree.treated[element]
        if tree.treated[tree.parents[element]] == GONE:
            tree.treated[element] = GONE
        elif treated in (SUSPECT, SUSPECT_BY_NAME) and length[element]:
            if 2 * links[element] > length[element] or (treated == SUSPECT_BY_NAME and not prose[element]):
                tree.treated[element] = GONE
    tree.blocks = [block for block in tree.blocks if tree.treated[block[0]] != GONE]


def main_text(page: str) -> str:
    """The article of a page, one line per block."""
    tree = _Tree(page)
    size = len(tree.names)
    if SUSPECT in tree.treated or SUSPECT_BY_NAME in tree.treated:
        _judge(tree)
    if not tree.blocks:
        return ""
    first, second, further = [0.0] * size, [0.0] * size, [0.0] * size
    for element, text, _ in tree.blocks:
        earned = len(text) / 100
        if len(text) >= LONG:
            earned = 1 + text.count(",") + min(earned, MOST_LENGTH_POINTS)
        first[tree.parents[element] if tree.names[element] in PARAGRAPHS else element] += earned
    for element in range(size - 1, 0, -1):  # children come after their parents
        above = tree.parents[element]
        second[above] += first[element] / 2
        further[above] += (second[element] + further[element]) / 3
    points = [0.0] + [first[e] + second[e] + further[e] for e in range(1, size)]
    length, links = _sizes(tree)
    scores = [p * (1 - links[e] / length[e]) if length[e] else 0.0 for e, p in enumerate(points)]
    best = max(range(size), key=lambda e: (scores[e], -e))
    above = best
    while above > 0:
        if tree.names[above] in ("article", "main"):
            best = above
            break
        above = tree.parents[above]
    kept = {best}
    if best > 0 and tree.names[best] not in WHOLE:
        parent = tree.parents[best]
        for element in range(1, size):
            if tree.parents[element] == parent and element != best and length[element]:
                density = links[element] / length[element]
                reads_on = tree.names[element] in PARAGRAPHS and length[element] > 80 and density < 0.25
                if scores[element] >= max(10.0, 0.2 * scores[best]) or reads_on:
                    kept.add(element)
    elif best > 0 and tree.names[best] == "article":
        # Further articles beside it that score like it belong to the page's text.
        parent = tree.parents[best]
        kept |= {
            element
            for element in range(1, size)
            if tree.parents[element] == parent
            and tree.names[element] == "article"
            and scores[element] >= max(10.0, 0.2 * scores[best])
        }
    inside = [False] * size
    for element in range(size):  # parents come before their children
        above = tree.parents[element]
        inside[element] = element in kept or (above >= 0 and inside[above])
        if inside[element] and element not in kept and tree.names[element] in ("ul", "ol"):
            # A list that is all links is a menu wherever it stands.
            if length[element] and links[element] / length[element] > 0.8:
                inside[element] = False
    if best == 0:
        inside = [True] * size
    return "\n".join(text for element, text, _ in tree.blocks if inside[element])


def extract_text(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) per page."""
    rows = pages.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html"))
    schema = rows.select("page_id", "url", F.lit("").alias("text")).schema

    def extract(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([main_text(page.as_py()) for page in batch.column("html")], pa.string())
            yield pa.RecordBatch.from_arrays(
                [batch.column("page_id"), batch.column("url"), texts], names=["page_id", "url", "text"]
            )

    found = rows.mapInArrow(releasing(extract), schema)
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


def op9_html_text(spark, sf_dir: str) -> DataFrame:
    """Main text of all pages."""
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet"))
