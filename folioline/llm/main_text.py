"""Main text of web pages by line-block distribution.

Markup is stripped so that every block element begins a line. Containers that are boilerplate
by their element, role or name (the last word of a class or id, words of layout aside; never the
container of all articles or of most of the page's text) leave a gap of blank lines. The distribution is the sum of text
lengths (link text not counted) over windows of ``WINDOW`` lines; the main text begins where it
surges for the first time, ends where it dives for the last time before a gap, and everything
between is kept, with the rest of a list, table or broken paragraph cut by either point unless
most of it is links. Where the page marks its article,
only lines within are considered, and any text there is above the border; elsewhere
the border is ``BORDER`` characters, or a third of the page's peak if that is less.

Defined results: null or empty html, or a page without text, gives an empty string; character
references are decoded, white space becomes one space, blocks are joined by one space; an
unclosed container is no container; an unclosed comment or script ends with the page; a
repeated row gives its row again; an empty table gives an empty result; further columns are ignored.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioline.session import ship_package

WINDOW = 3
BORDER = 86

#: Elements that begin and end a line.
BLOCKS = frozenset(
    "address article aside blockquote body br caption center dd details dialog dir div dl dt fieldset figcaption "
    "figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol option p pre section "
    "summary table tbody td tfoot th thead title tr ul".split()
)
#: Elements whose lines belong together.
GROUPS = frozenset("ul ol dl table blockquote".split())
#: Elements whose content is no page text.
RAW = frozenset("script style textarea noscript template iframe svg math select button object canvas audio video head title".split())
#: Elements that are boilerplate wherever they stand.
CONTAINERS = frozenset("nav footer aside form menu dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alertdialog alert form menu menubar toolbar".split())
#: Words of a class or id that name boilerplate.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising sponsor sponsored promo promotion banner comment comments disqus reply "
    "replies respond sidebar sidebars aside menu nav navbar navigation breadcrumb breadcrumbs footer cookie cookies consent "
    "gdpr notice notices notification popup modal overlay newsletter subscribe subscription share sharing social related "
    "recommended widget widgets pagination pager toolbar login signup search copyright legal disclaimer skip toc".split()
)
#: Words after which a name says how a box looks, and words before it that speak of its neighbour.
LAYOUT = frozenset(
    "area bar block body bottom box button buttons center col column container content field footer form group head header "
    "icon icons image images inner item items label left link links list main outer panel post posts right row section "
    "slot text title top unit wrap wrapper".split()
)
STATES = frozenset("has no with without show hide hidden is not".split())
#: Boilerplate only outside an article, where they may hold its headline.
HEADS = frozenset(["header", "masthead", "topbar"])
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*)>|<[!?][^>]*(?:>|\Z)", re.S
)
_NAME = re.compile(r"\b(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?=[\s=/]|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


def _boilerplate(tag: str, attributes: str, inside: bool) -> bool:
    if tag in CONTAINERS or (not inside and tag == "header"):
        return True
    if not attributes or tag in ("html", "body", "article", "main"):
        return False
    if _HIDDEN.search(attributes):
        return True
    for name, *values in _NAME.findall(attributes):
        value = "".join(values)
        if name.lower() == "role":
            if value.lower() in ROLES:
                return True
            continue
        for token in value.split():
            found = [w.lower() for w in _WORD.findall(token)]
            if STATES & set(found[:-1]):
                continue
            names = NAMES if inside else NAMES | HEADS
            while len(found) > 1 and found[-1] in LAYOUT - names:
                found.pop()
            if found and found[-1] in names:
                return True
    return False


_ARTICLE = re.compile(r"<(?:article|main)(?=[\s/>])", re.I)
_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][a-zA-Z0-9:-]*)(?=[\s/>])(?:[^<>\"']|\"[^\"]*\"|'[^']*')*+>|<[!?][^<>]*>", re.S
)
#: Elements whose text is no text outside links.
_UNSEEN = frozenset("script style a title textarea select".split())
_UNSEEN_END = re.compile(r"</(script|style|a|title|textarea|select)\s*>", re.I)


class _Page:
    """What the containers of a page ask for, found in two passes over it."""

    def __init__(self, page: str):
        self.articles = [m.start() for m in _ARTICLE.finditer(page)]
        closers: dict[str, tuple[list[int], list[int]]] = {tag: ([], []) for tag in _UNSEEN}
        for match in _UNSEEN_END.finditer(page):
            for places, place in zip(closers[match.group(1).lower()], match.span(), strict=True):
                places.append(place)

        def after(match: re.Match, skipped: tuple | frozenset) -> int:
            """Where to go on: behind the element if its text is skipped and it is closed."""
            tag = (match.group(2) or "").lower()
            if tag in skipped and not match.group(1):
                starts, ends = closers[tag]
                number = bisect_left(starts, match.end())
                if number < len(ends):
                    return ends[number]
            return match.end()

        # Text outside links up to the end of each piece of it.
        self.places, self.sums = [0], [0]
        at = 0
        while match := _TOKEN.search(page, at):
            self._text(page, at, match.start())
            at = after(match, _UNSEEN)
        self._text(page, at, len(page))
        self.ends: dict[int, int] = {}
        opened: dict[str, list[int]] = {}
        at = 0
        while match := _TOKEN.search(page, at):
            at = after(match, ("script", "style"))
            tag = (match.group(2) or "").lower()
            if tag and not match.group(1):
                opened.setdefault(tag, []).append(match.start())
            elif opened.get(tag):
                self.ends[opened[tag].pop()] = match.end()

    def _text(self, page: str, at: int, end: int) -> None:
        if end > at:
            self.places.append(end)
            self.sums.append(self.sums[-1] + sum(map(len, page[at:end].split())))

    def closing(self, start: int) -> int | None:
        """Where the element that begins at ``start`` ends."""
        return self.ends.get(start)

    def holds_article(self, at: int, end: int, inside: bool) -> bool:
        """Whether page[at:end] has all of the page's articles or, where none is marked outside of it,
        most of the page's text."""
        if not inside:
            first, last = bisect_left(self.articles, at), bisect_left(self.articles, end)
            if first or last < len(self.articles):
                return False
            if last > first:
                return True
        own = self.sums[bisect_right(self.places, end) - 1] - self.sums[bisect_right(self.places, at) - 1]
        return 2 * own > self.sums[-1]


class _Lines:
    """Lines of (text, weight, inside an article); a gap is a run of lines without text.

    Lines of one list, table or broken paragraph have one number in ``groups``.
    """

    def __init__(self):
        self.rows: list[tuple[str, int, bool]] = []
        self.groups: list[int] = []
        self.group = self.depth = 0
        self.parts: list[str] = []
        self.weight = 0

    def text(self, raw: str, linked: bool) -> None:
        self.parts.append(raw)
        if not linked:
            self.weight += len(raw.strip())

    def end(self, inside: bool) -> None:
        if self.parts:
            text = " ".join(html.unescape("".join(self.parts)).split())
            if text:
                self.rows.append((text, self.weight, inside))
                self.groups.append(self.group)
            self.parts, self.weight = [], 0

    def gap(self) -> None:
        if self.rows and self.rows[-1][0]:
            self.rows.extend([("", 0, False)] * WINDOW)
            self.groups.extend([0] * WINDOW)

    def block(self, tag: str, closes: bool) -> None:
        if tag in GROUPS:
            self.depth = max(0, self.depth - 1) if closes else self.depth + 1
            self.group += self.depth == (0 if closes else 1)
        elif tag != "br" and not self.depth:
            self.group += 1


@cache
def _closes(tag: str) -> re.Pattern:
    return re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I)


def _read(page: str, structural: bool) -> _Lines:
    lines, at, inside, links = _Lines(), 0, 0, 0
    whole = _Page(page) if structural else None
    unclosed: set[str] = set()
    while match := _TAG.search(page, at):
        if match.start() > at:
            lines.text(page[at : match.start()], links > 0)
        at = match.end()
        tag = (match.group(2) or "").lower()
        if not tag:
            continue
        closes, attributes = bool(match.group(1)), match.group(3)
        if tag in RAW and not closes and not attributes.endswith("/"):
            end = _closes(tag).search(page, at) if tag not in unclosed else None
            if not end:
                unclosed.add(tag)
            if end or tag in ("script", "style"):
                lines.end(inside > 0)
                at = end.end() if end else len(page)
            continue
        if structural and not closes and tag not in VOID and _boilerplate(tag, attributes, inside > 0):
            end = whole.closing(match.start())
            named = tag not in CONTAINERS and not _HIDDEN.search(attributes)
            if end is not None and not (named and whole.holds_article(at, end, inside > 0)):
                lines.end(inside > 0)
                lines.gap()
                at = end
                continue
        if tag in BLOCKS:
            lines.end(inside > 0)
            lines.block(tag, closes)
        if tag in ("article", "main"):
            lines.gap()
            inside = max(0, inside - 1) if closes else inside + 1
        if tag == "a":
            links = 0 if closes else 1
    if at < len(page):
        lines.text(page[at:], links > 0)
    lines.end(inside > 0)
    return lines


def kept_lines(rows: list[tuple[str, int, bool]], groups: list[int] | None = None) -> list[str]:
    """The lines between the first surge and the last dive of each stretch without a gap."""
    marked = any(inside and text for text, _, inside in rows)
    if marked:
        rows = [row if row[2] else ("", 0, False) for row in rows]
        weights = [len(text) for text, _, _ in rows]
    else:
        weights = [weight for _, weight, _ in rows]
    blocks = [sum(weights[i : i + WINDOW]) for i in range(len(rows))]
    if not blocks:
        return []
    border = 1 if marked else max(1, min(BORDER, max(blocks) // 3))
    # The dive: neither this window nor those that end here reach the border.
    reach = [text and max(blocks[max(0, i - WINDOW + 1) : i + 1]) >= border for i, (text, _, _) in enumerate(rows)]
    whole = _unlinked_groups(rows, groups) if groups else set()
    kept, at = [], 0
    while at < len(rows):
        end = at
        while end < len(rows) and rows[end][0]:
            end += 1
        surges = [i for i in range(at, end) if blocks[i] >= border]
        if surges:
            first, last = surges[0], max(i for i in range(at, end) if reach[i])
            if groups:
                while first > at and groups[first - 1] == groups[first] and groups[first] in whole:
                    first -= 1
                while last + 1 < end and groups[last + 1] == groups[last] and groups[last] in whole:
                    last += 1
            kept += [text for text, _, _ in rows[first : last + 1]]
        at = end + 1
    return kept


def _unlinked_groups(rows: list[tuple[str, int, bool]], groups: list[int]) -> set[int]:
    """Groups of which at least half of the text is outside links."""
    balance: dict[int, int] = {}
    for (text, weight, _), group in zip(rows, groups, strict=True):
        balance[group] = balance.get(group, 0) + 2 * weight - len(text)
    return {group for group, rest in balance.items() if rest >= 0}


def main_text(page: str | None) -> str:
    if not page:
        return ""
    for structural in (True, False):
        # A page of nothing but boilerplate names: trust the distribution alone.
        lines = _read(page, structural)
        if found := kept_lines(lines.rows, lines.groups):
            return " ".join(found)
    return ""


def _text_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(page) for page in batch.column("html").to_pylist()]
        columns = [batch.column("page_id"), batch.column("url"), pa.array(texts, pa.string())]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
        )


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for each row of (page_id, url, html)."""
    ship_package(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
                        F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(_text_rows, "page_id long, url string, text string, n_chars long")
