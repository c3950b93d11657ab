"""Main text of web pages by composite text density.

Each page becomes a flat tree in page order. Every node has a density, its characters per tag
damped by its share of link characters and link tags; a node's sum adds its children's densities.
The node with the largest sum holds the main text. The least density on its path to the body is the
threshold above which other subtrees may count as text too: those whose own largest sum is
comparable (``SHARE`` of the largest). Where such a part lies in the same container, the container
is the text as a whole. A heading just before the text, beside its path to the body, goes with it.

Before that, parts that are no article whatever their density (scripts, menus, forms, adverts,
reader comments and the like) are left out by a prior on element, role, class or id. It is no more
than that: ``main_text(page, prior=False)`` knows only elements without text, such as scripts.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 "
    "header hr html legend li main menu nav ol option p pre section summary table tbody td tfoot th thead tr ul caption".split()
)
#: Elements that mark an article: a part that holds all of a page's is not outside it.
CORE = frozenset("article main h1".split())
#: Elements whose content is not text on the page.
RAW_PARTS = frozenset("script style noscript template svg math canvas audio video iframe object embed applet head title xmp noembed noframes".split())
#: By the prior, never part of an article's text.
NO_TEXT = RAW_PARTS | frozenset("form button input select textarea datalist nav aside footer dialog menu".split())
HEADINGS = frozenset("h1 h2 h3".split())
#: The part of the largest sum that makes another subtree comparable.
SHARE = 0.5
#: An opening tag closes these, if open, up to the given scope.
CLOSES = {
    "li": (frozenset(["li"]), frozenset(["ul", "ol", "menu"])),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "tr": (frozenset(["tr", "td", "th"]), frozenset(["table"])),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
}
ENDS_P = BLOCK - frozenset("html body td th tr tbody thead tfoot caption option legend summary".split())
#: Words of a class, id or role that name a part outside the article.
OUTSIDE = frozenset(
    "nav navbar navigation menu menubar breadcrumb breadcrumbs sidebar footer contentinfo complementary comments comment commentlist respond disqus "
    "replies reply discussion cookie cookies consent gdpr notice notices popup modal overlay newsletter subscribe signup login search "
    "ad ads advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promotion banner".split()
)
#: The same, but only for parts with less than half of the page's text.
MINOR = frozenset(
    "header masthead topbar toolbar share sharing social related recommended recommendations widget widgets pagination pager skip copyright "
    "disclaimer alert dialog form tags toc rail sticky hidden announcement".split()
)
#: Words that make a named part a frame, which may hold the article as well.
FRAME = frozenset("wrap wrapper container layout page grid row main content body inner".split())
WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
ATTRIBUTE = re.compile(r"""(class|id|role|style|hidden|aria-hidden|aria-label)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""", re.I)
TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*)>""")
HIDDEN_STYLE = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Page:
    """A page's nodes in page order: tag, parent, kind of outsider, and pieces of text by node and block."""

    def __init__(self, source: str):
        self.tags, self.parents, self.outside = ["#root"], [-1], [0]
        self.pieces: list[tuple[int, int, str]] = []
        self.block = 0
        self._open = [0]
        self._count: Counter[str] = Counter()
        self._read(source)

    def _shut(self, k: int) -> None:
        self._count.subtract(self.tags[i] for i in self._open[k:])
        del self._open[k:]

    def _text(self, raw: str) -> None:
        if raw:
            self.pieces.append((self._open[-1], self.block, html.unescape(raw) if "&" in raw else raw))

    def _read(self, s: str) -> None:
        i, n = 0, len(s)
        while i < n:
            j = s.find("<", i)
            if j < 0:
                self._text(s[i:])
                return
            self._text(s[i:j])
            if s.startswith("<!--", j):
                k = s.find("-->", j + 4)
                i = n if k < 0 else k + 3
                continue
            if s.startswith(("<!", "<?"), j):
                k = s.find(">", j)
                i = n if k < 0 else k + 1
                continue
            m = TAG.match(s, j)
            if not m:
                if re.match(r"</?[a-zA-Z]", s[j : j + 3]):
                    k = s.find(">", j)
                    i = n if k < 0 else k + 1
                else:
                    self._text("<")
                    i = j + 1
                continue
            i = m.end()
            name = m[2].lower()
            if m[1]:
                self._close(name)
                continue
            self._start(name, m[3])
            if name in RAW:
                end = re.compile(rf"</{re.escape(name)}(?=[\s/>])[^>]*>", re.I).search(s, i)
                self._shut(len(self._open) - 1)
                i = end.end() if end else n

    def _start(self, name: str, attributes: str) -> None:
        if name in ENDS_P:
            self._pop_to(frozenset(["p"]), frozenset("td th table button object caption".split()))
        if name in CLOSES:
            self._pop_to(*CLOSES[name])
        if name in BLOCK:
            self.block += 1
        if name == "br":
            self.pieces.append((self._open[-1], self.block, " "))
        self.tags.append(name)
        self.parents.append(self._open[-1])
        self.outside.append(2 if name in NO_TEXT else self._named(name, attributes) if attributes else 0)
        if name not in VOID and not attributes.rstrip().endswith("/") or name in RAW:
            self._open.append(len(self.tags) - 1)
            self._count[name] += 1

    def _pop_to(self, names: frozenset, scope: frozenset) -> None:
        if not any(self._count[x] for x in names):
            return
        for k in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[k]]
            if tag in names:
                self._shut(k)
                self.block += 1
                return
            if tag in scope:
                return

    def _close(self, name: str) -> None:
        if name in BLOCK:
            self.block += 1
        elif name == "br":
            self._text(" ")
        if not self._count[name]:
            return
        for k in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[k]] == name:
                self._shut(k)
                return
            if self.tags[self._open[k]] in ("td", "th", "table") and name not in BLOCK:
                return

    @staticmethod
    def _named(name: str, attributes: str) -> int:
        """2: outside the article, 1: outside if it has less than half of the text, 0: no sign of it."""
        if name in ("html", "body", "article", "main"):
            return 0
        worst = 0
        for key, value in ATTRIBUTE.findall(attributes):
            key, value = key.lower(), value.strip("\"'")
            if key == "hidden" or (key == "aria-hidden" and value.lower() == "true") or (key == "style" and HIDDEN_STYLE.search(value)):
                return 2
            if key in ("class", "id", "role", "aria-label"):
                named = [w.lower() for w in WORD.findall(value)]
                words = {w for before, w in zip(["", *named], named, strict=False) if before not in ("has", "with", "no", "without")}
                if words & OUTSIDE:
                    if not words & FRAME:
                        return 2
                    worst = 1
                if words & MINOR:
                    worst = 1
        return worst


def densities(page: Page, kept: list[bool]) -> tuple[list[float], list[float], list[int], int]:
    """Density and sum of each node, the node of largest sum in each subtree, and the body's number."""
    n = len(page.tags)
    chars, tags, link_chars, link_tags = [0] * n, [0] * n, [0] * n, [0] * n
    for node, _, text in page.pieces:
        if kept[node]:
            chars[node] += len(" ".join(text.split()))
    for i in range(n - 1, 0, -1):
        if not kept[i]:
            continue
        if page.tags[i] == "a":
            link_chars[i], link_tags[i] = chars[i], link_tags[i] + 1
        p = page.parents[i]
        chars[p] += chars[i]
        tags[p] += tags[i] + 1
        link_chars[p] += link_chars[i]
        link_tags[p] += link_tags[i]
    body = next((i for i, t in enumerate(page.tags) if t == "body"), 0)
    ratio = link_chars[body] / max(1, chars[body])
    density, total = [0.0] * n, [0.0] * n
    for i in range(n):
        if kept[i] and chars[i]:
            c, t, lc, lt = chars[i], max(1, tags[i]), max(1, link_chars[i]), max(1, link_tags[i])
            base = math.log(c / max(1, c - link_chars[i]) * link_chars[i] + ratio * c + math.e)
            density[i] = c / t * math.log(max(1.0, c / lc * t / lt)) / math.log(max(base, 1.0001)) if base > 1 else c / t * math.log(max(1.0, c / lc * t / lt) + 1)
    best, outer = list(range(n)), [False] * n
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        total[p] += density[i]
        outer[p] = outer[p] or outer[i] or (kept[i] and page.tags[i] in BLOCK)
    # A paragraph counts by its own density, however its text is cut up by tags within lines.
    for i in range(1, n):
        if not outer[i]:
            total[i] = density[i] if page.tags[i] in BLOCK else 0.0
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if kept[i] and total[best[i]] > total[best[p]]:
            best[p] = best[i]
    return density, total, best, body


def _kept(page: Page) -> list[bool]:
    """Which nodes are not within a part outside the article."""
    n = len(page.tags)
    chars, core = [0] * n, [int(t in CORE) for t in page.tags]
    cored = sum(core)
    for node, _, text in page.pieces:
        chars[node] += len(text)
    no_text = [t in NO_TEXT for t in page.tags]
    for i in range(n - 1, 0, -1):
        p = page.parents[i]
        if not no_text[i]:
            chars[p] += chars[i]
            core[p] += core[i]
    kept, in_article = [True] * n, [False] * n
    text_left = chars[0]
    for sure in (True, False):
        for i in range(1, n):
            p = page.parents[i]
            in_article[i] = in_article[p] or page.tags[i] in ("article", "main")
            drop = page.outside[i]
            if page.tags[i] == "header" and not in_article[p]:
                drop = max(drop, 1)
            alone = core[i] == cored if cored else drop == 2 and 2 * chars[i] > text_left
            if not no_text[i] and (alone or (drop == 1 and not core[i] and 2 * chars[i] > text_left)):
                drop = 0
            kept[i] = kept[p] and not (drop == 2 or (drop == 1 and not sure))
            if sure and kept[p] and not kept[i] and not no_text[i]:
                text_left -= chars[i]
    return kept


def _raw_kept(page: Page) -> list[bool]:
    kept = [True] * len(page.tags)
    for i in range(1, len(kept)):
        kept[i] = kept[page.parents[i]] and page.tags[i] not in RAW_PARTS
    return kept


def chosen_nodes(page: Page, kept: list[bool]) -> list[bool]:
    """Which nodes are text: the subtree of the largest sum and those comparable with it."""
    density, total, best, body = densities(page, kept)
    n = len(page.tags)
    mass = [max(total[best[i]], density[i]) for i in range(n)]
    top = best[body] if total[best[body]] > 0 else body
    path = [top]
    while path[-1] != body and page.parents[path[-1]] >= 0:
        path.append(page.parents[path[-1]])
    threshold, least = min(density[i] for i in path), SHARE * mass[top]
    place = {node: k for k, node in enumerate(path)}
    beside: list[list[int]] = [[] for _ in path]
    for i in range(1, n):
        if kept[i] and i not in place and page.parents[i] in place:
            beside[place[page.parents[i]]].append(i)
    comparable = lambda i: density[i] >= threshold and mass[i] >= least
    # The highest container, below the body, that holds another comparable part.
    level = max([k for k in range(1, len(path) - 1) if any(map(comparable, beside[k]))], default=0)
    chosen = [False] * n
    chosen[path[level]] = True
    for k in range(level + 1, len(path)):
        for i in beside[k]:
            if page.tags[i] in HEADINGS and i < path[k - 1]:
                chosen[i] = True
            elif comparable(i):
                chosen[best[i] if total[best[i]] > 0 else i] = True
    for i in range(1, n):
        if page.parents[i] >= 0 and chosen[page.parents[i]]:
            chosen[i] = True
    return chosen


def main_text(source: str, prior: bool = True) -> str:
    page = Page(source)
    kept = _kept(page) if prior else _raw_kept(page)
    chosen = chosen_nodes(page, kept)
    blocks: list[str] = []
    at = None
    for node, block, text in page.pieces:
        if kept[node] and chosen[node]:
            if block == at:
                blocks[-1] += text
            else:
                blocks.append(text)
                at = block
    return "\n\n".join(b for b in (" ".join(b.split()) for b in blocks) if b)


def _extracted(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        text = [main_text(h) for h in pdf["html"]]
        yield pdf.drop(columns="html").assign(text=text, n_chars=[len(t) for t in text])


def extract_pages(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """One row per page: its id and url, ``text`` and ``n_chars``.

    A null or empty page, and one without text, gives an empty text. Source without any markup is
    one block. Of equal sums the first node in page order counts. A page of any length is read
    whole, by one task that holds its tree. Rows that repeat are extracted each; null ids and urls
    stay null; other columns are ignored, whatever their names. An empty table gives an empty
    result.
    """
    given = pages.select(
        F.col(id_col).cast("string").alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(html_col).cast("string"), F.lit("")).alias("html")
    )
    made = given.mapInPandas(_extracted, "id string, url string, text string, n_chars long")
    kind = pages.schema[id_col].dataType
    return made.select(F.col("id").cast(kind).alias(id_col), F.col("url").alias(url_col), "text", "n_chars")
