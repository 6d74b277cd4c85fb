"""Main text of web pages by tag-path ratios.

A page is cut into blocks of text. Each block has a path: the open elements from the root down, with the words of
their class and id. Elements that never hold main text (scripts, forms, navigation, asides, footers, blocks whose
class or id says advert, sidebar, comments and so on) are left out; but a container that only its class words or being
a form rule out stays if an article or main lies in it, or if no prose is left of the page without it. Over the
rest, text length and punctuation are
aggregated per path (a menu has many short blocks without punctuation, an article long ones with much), smoothed over
neighbouring blocks of the same section, and fused to one ratio. The best path names the content root: article and
main if it lies in one, else its section. Inside the root all paths are content but those of links alone; elsewhere
those are whose ratio passes a share of the best. All blocks of content paths are kept.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of HTML: elements without an end tag; elements inside a line; elements that close an open one of
#: their group; elements without main text; sections.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span "
    "strike strong sub sup time tt u var wbr img".split()
)
CLOSES = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"},
    "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("table ul ol dl article section main aside nav div body html form".split())
NO_TEXT = frozenset(
    "head script style noscript template nav footer aside button select textarea iframe object svg canvas menu "
    "dialog audio video title math".split()
)
SECTIONS = frozenset("article main section div body td".split())
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert menu menubar".split())
#: Words in class or id that say: not main text.
NOT_MAIN = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored promo promotion banner nav navbar "
    "navigation menu menubar breadcrumb breadcrumbs sidebar aside widget footer masthead topbar header comment comments "
    "disqus reply replies cookie cookies consent gdpr notice notices alert popup modal overlay newsletter subscribe "
    "subscription signup login share sharing social related recommended recommendations pagination pager toolbar skip "
    "legal copyright disclaimer form search hidden".split()
)
#: Of these, the ones that name an article's own head when they stand inside it.
HEADS = frozenset("header masthead banner".split())
#: Elements that their class or id doesn't rule out.
WHOLE = frozenset("html body article main".split())
PUNCTUATION = frozenset(".,;:!?…。、，！？；：¿¡")
#: A class token that says how something is shown or what lies beside it, not what it is.
MODIFIER = re.compile(r"(?i)^(?:has|have|with|without|no|not|is|overflow|text|js)[-_]|:|__|--")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")

#: A path outside the content root is content if its ratio is at least this share of the page's best path.
SHARE = 0.08
#: Blocks inside article or main count this much more than others.
MAIN_PRIOR = 4.0
#: A page keeps what a class word rules out if less than this share of its text would be left, and no block of prose
#: (punctuated, of so many characters at least) among it.
LEFT_SHARE, PROSE_CHARS = 0.1, 40
#: A block with this share of its characters in links is navigation.
LINK_SHARE = 0.6


class _Blocks(HTMLParser):
    """Collects ``(path, section, in_main, text, characters in links)`` per block, in page order, and for each block the
    numbers of the containers around it that class words rule out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str, bool, int]] = []  # name, part of the path, without main text, number if doubtful
        self.skipped = 0
        self.parts: list[str] = []
        self.linked = 0
        self.blocks: list[tuple[str, str, bool, str, int]] = []
        self.doubts: list[tuple[int, ...]] = []
        self.doubtful = 0
        self.around_main: set[int] = set()

    def parse_html_declaration(self, i: int) -> int:
        """A declaration that the parser can't read ends at the next ``>``."""
        try:
            return super().parse_html_declaration(i)
        except AssertionError:
            end = self.rawdata.find(">", i)
            return end + 1 if end >= 0 else len(self.rawdata)

    def end_block(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            path = [x[1] for x in self.open if x[0] not in INLINE]
            at = max((i for i, x in enumerate(self.open) if x[0] in SECTIONS), default=-1)
            section = "/".join(x[1] for x in self.open[: at + 1])
            self.blocks.append(("/".join(path), section, any(x[0] in MAIN for x in self.open), text, self.linked))
            self.doubts.append(tuple(x[3] for x in self.open if x[3]))
        self.parts, self.linked = [], 0

    def pop_to(self, at: int) -> None:
        if any(x[0] not in INLINE for x in self.open[at:]):
            self.end_block()
        self.skipped -= sum(x[2] for x in self.open[at:])
        del self.open[at:]

    def close_implied(self, tag: str) -> None:
        if tag not in INLINE:
            at = next((i for i in range(len(self.open) - 1, -1, -1) if self.open[i][0] == "p" or self.open[i][0] in SCOPES), -1)
            if at >= 0 and self.open[at][0] == "p":
                self.pop_to(at)
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] in CLOSES.get(tag, ()):
                return self.pop_to(i)
            if self.open[i][0] in SCOPES:
                return None
        return None

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in ("html", "body") and any(x[0] == tag for x in self.open):
            return
        if tag == "body":  # an unclosed head ends here
            at = next((i for i, x in enumerate(self.open) if x[0] == "head"), None)
            if at is not None:
                self.pop_to(at)
        if tag == "br":
            self.parts.append(" ")
            return
        self.close_implied(tag)
        if tag not in INLINE:
            self.end_block()
        if tag in VOID:
            return
        names = {k: v or "" for k, v in attrs}
        inside_main = any(x[0] in MAIN for x in self.open)
        tokens = [t for k in ("class", "id") for t in names.get(k, "").split()]
        words = {w.lower() for t in tokens for w in _PARTS.findall(t)} | {re.sub("[-_]", "", t.lower()) for t in tokens}
        # An id inside an article is an anchor, named after what its section is about.
        telling = [t for k in (("class",) if inside_main else ("class", "id")) for t in names.get(k, "").split() if not MODIFIER.search(t)]
        told = {w.lower() for t in telling for w in _PARTS.findall(t)} | {re.sub("[-_]", "", t.lower()) for t in telling}
        skip = (
            tag in NO_TEXT or names.get("role", "").lower() in ROLES or "hidden" in names or names.get("aria-hidden") == "true"
            or (tag == "header" and not inside_main)
        )
        doubt = tag == "form" or bool(told & (NOT_MAIN - HEADS if inside_main else NOT_MAIN)) and tag not in WHOLE
        if tag in MAIN and not self.skipped and not skip:
            self.around_main.update(x[3] for x in self.open if x[3])
        self.doubtful += doubt
        part = tag + "".join(f".{w}" for w in sorted(words))
        self.open.append((tag, part, skip, self.doubtful if doubt else 0))
        self.skipped += skip

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag not in VOID and self.open and self.open[-1][0] == tag:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if tag in ("html", "body") or tag in VOID:
            return
        for i in range(len(self.open) - 1, -1, -1):
            if self.open[i][0] == tag:
                return self.pop_to(i)
            if tag in INLINE and self.open[i][0] not in INLINE:
                return None  # a stray end of an inline element doesn't close blocks
        return None

    def handle_data(self, data: str) -> None:
        if not self.skipped:
            self.parts.append(data)
            if any(x[0] == "a" for x in self.open):
                self.linked += len("".join(data.split()))


def _is_prose(text: str, linked: int) -> bool:
    """A sentence: long enough, punctuated, and no list of links."""
    return len(text) >= PROSE_CHARS and not PUNCTUATION.isdisjoint(text) and linked <= LINK_SHARE * len(text)


def page_blocks(html: str) -> list[tuple[str, str, bool, str, int]]:
    parser = _Blocks()
    parser.feed(html)
    parser.close()
    parser.end_block()
    out = [all(d in parser.around_main for d in doubt) for doubt in parser.doubts]
    size = [len(b[3]) for b in parser.blocks]
    left = [b for b, keep in zip(parser.blocks, out, strict=True) if keep]
    if sum(len(b[3]) for b in left) < LEFT_SHARE * sum(size) and not any(_is_prose(b[3], b[4]) for b in left):
        # Nothing of the page's prose is left: the containers around most of the text stay, those beside it go.
        held: dict[int, int] = defaultdict(int)
        for doubt, n in zip(parser.doubts, size, strict=True):
            for d in doubt:
                held[d] += n
        around = {d for d, n in held.items() if 2 * n > sum(size)} | parser.around_main
        out = [all(d in around for d in doubt) for doubt in parser.doubts]
    return [b for b, keep in zip(parser.blocks, out, strict=True) if keep]


def content_blocks(html: str) -> list[str]:
    """The text blocks of the main content, in page order."""
    blocks = page_blocks(html)
    chars, points, count = defaultdict(int), defaultdict(int), defaultdict(int)
    for path, _, _, text, linked in blocks:
        length = sum(map(len, text.split()))
        menu = linked > LINK_SHARE * length
        count[path] += 1
        chars[path] += 0 if menu else length
        points[path] += 0 if menu else sum(map(text.count, PUNCTUATION))
    lengths = [chars[b[0]] / count[b[0]] for b in blocks]
    marks = [points[b[0]] / count[b[0]] for b in blocks]

    def smooth(x: list[float]) -> list[float]:
        """Weights 1, 2, 1 over the block and its neighbours in the same section; never below the block's own."""
        out = []
        for i, b in enumerate(blocks):
            near = [x[j] for j in (i - 1, i + 1) if 0 <= j < len(blocks) and blocks[j][1] == b[1]]
            out.append(max(x[i], (2 * x[i] + sum(near)) / (2 + len(near))))
        return out

    best: dict[str, float] = {}
    for b, length, mark in zip(blocks, smooth(lengths), smooth(marks), strict=True):
        fused = length * (1 + mark) * (MAIN_PRIOR if b[2] else 1.0)
        best[b[0]] = max(best.get(b[0], 0.0), fused)
    top = max(best.values(), default=0.0)
    if not top:
        return []
    lead = next(b for b in blocks if best[b[0]] == top)
    # A section that the page as a whole is says nothing of what lies below it.
    below = lead[1] + "/" if lead[1].rsplit("/", 1)[-1].split(".")[0] not in ("", "body") else None

    def in_root(b: tuple[str, str, bool, str, int]) -> bool:
        if lead[2]:
            return b[2]
        return b[1] == lead[1] or below is not None and b[1].startswith(below)

    return [b[3] for b in blocks if best[b[0]] >= SHARE * top or in_root(b) and chars[b[0]] > 0]


def extract_text(pages: DataFrame, html: str = "html") -> DataFrame:
    """``pages`` rows as ``(page_id, url, text, n_chars)``: the main text, blocks joined by an empty line.

    NULL or empty html and pages without content: the empty text. NULL and repeated ids are kept row by row; the whole
    html is read. An empty table gives an empty result; extra columns are not read.
    """

    def extract(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in texts:
            yield batch.map(lambda h: "\n\n".join(content_blocks(h)) if isinstance(h, str) else "")

    main = F.pandas_udf(extract, "string")
    rows = pages.select("page_id", "url", main(F.col(html)).alias("text"))
    return rows.withColumn("n_chars", F.char_length("text").cast("long"))
