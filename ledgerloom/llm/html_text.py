"""Main text of web pages from parser events and text-to-tag ratios.

The standard library's parser streams a page as events, which are cut into lines: one
for each block of text, with the number of tags met since the last. The ratio of text
to tags of each line, smoothed by a Gaussian over its neighbours, is high where prose
stands. A threshold from the spread of the smoothed ratios clusters the lines into
prose and other; the smallest container that holds all of the prose is the content
region, and all of its lines are the text, short ones between long ones included. Where
an article or main holds most of the prose, only its prose counts, and the region is
never a part of it. Lists, tables, quotes and figures are no regions. Lines inside
elements that never hold an article (menus, footers, scripts) are in no region, nor are
those of forms, page headers and elements named as adverts, side bars, notices or
comments, unless such an element encloses the article or holds most of the prose, or
nothing else has text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._store import pick, ship

#: Elements without content, by role.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NEVER = frozenset("head title script style noscript template nav footer aside button select textarea iframe object svg canvas dialog menu".split())
#: Of these, the ones that stand within a line: they are left out without ending it.
INLINE = frozenset("script style noscript template button select textarea iframe object svg canvas".split())
CONTAINER = frozenset("html body article main section form div ul ol dl table tbody thead tr figure blockquote details header hgroup center".split()) | NEVER
#: Containers that may be the region; what lies in any other container isn't one either.
REGION = frozenset("html body article main section form div center details".split())
WHOLE = frozenset("article main".split())
BLOCK = CONTAINER | frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption pre address hr summary legend fieldset option".split())
#: All that stands in a head; any other tag or text ends it.
HEAD = frozenset("html head title base link meta script style noscript template".split())
#: Names of elements that hold no article: what the last word of a class or id names.
NAMED = frozenset(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer header masthead menu modal nav navbar navigation newsletter notice notices notification overlay pagination pager popup promo promoted related "
    "respond share sharing sidebar signup skip social sponsor sponsored subscribe toolbar topbar widget widgets".split()
)
#: Names of what readers write, which may be longer than the article.
REPLIES = frozenset("comment comments commentlist disqus respond".split())
#: Words that only say which part of the named thing an element is.
PART = frozenset("area bar block bottom box inner item items left link links list main outer post posts right section text top".split())
#: Words that tell how a page is laid out: a class or id with one names nothing.
LAYOUT = frozenset("has hide is no non not show with without".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog form menu menubar".split())
SIGMA = 1.0
#: Lines above this many standard deviations of the smoothed ratios are prose.
SPREAD = 0.5
_PARTS = re.compile(r"[A-Za-z]+")
_COMMENT_END = re.compile(r"--!?>")
_UNFINISHED = re.compile(r"(?s)<[A-Za-z/!?].*")


def _names(token: str) -> str:
    """The word of a class or id that says what the element is, or nothing."""
    words = [w.lower() for w in _PARTS.findall(token)]
    if LAYOUT.intersection(words):
        return ""
    while words and words[-1] in PART:
        words.pop()
    return words[-1] if words else ""


class _Lines(HTMLParser):
    """Lines (text, tags, number of the innermost open container) of a page, and its containers.

    Containers are numbered as they open, so a parent's number is below its children's;
    0 is the page itself.
    """

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[int] = [0]
        self.open_tags: Counter[str] = Counter()
        self.once: set[str] = set()
        self.tags = 0
        self.parts: list[str] = []
        self.out: list[tuple[str, int, int]] = []
        # of each container: tag, parent, whether it never holds content, whether it is or lies in an article or main,
        # and the name by which it may hold none
        self.tag, self.parent, self.never, self.inside, self.doubt = [""], [0], [False], [False], [""]
        # whether it is or lies in an inline element that is left out; the innermost that doesn't, whose line goes on
        self.left_out, self.shown = [False], 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split())
        if text:
            self.out.append((text, self.tags, self.shown))
            self.tags = 0
        self.parts = []

    def parse_html_declaration(self, i: int) -> int:
        """As browsers have it: a marked section is a comment up to the next >, a comment without an end goes on to the page's end."""
        if self.rawdata.startswith("<![", i):
            return self.parse_bogus_comment(i)
        return super().parse_html_declaration(i)

    def parse_comment(self, i: int, report: bool = True) -> int:
        short = next((x for x in ("<!-->", "<!--->") if self.rawdata.startswith(x, i)), "")
        end = _COMMENT_END.search(self.rawdata, i + 4)
        return i + len(short) if short else end.end() if end else len(self.rawdata)

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag not in HEAD:
            self._end_head()
        self.tags += 1
        if tag == "br":
            self.parts.append(" ")
        if tag not in BLOCK:
            return
        if tag not in INLINE and not self.left_out[self.open[-1]]:
            self.flush()
        if tag in ("html", "body"):
            if tag in self.once:  # a second one only repeats the first
                return
            self.once.add(tag)
        if tag == "body":
            while self.open[-1] and self.tag[self.open[-1]] != "html":
                self._close()
        if tag in CONTAINER and tag not in VOID:
            top = self.open[-1]
            self.open.append(len(self.tag))
            self.open_tags[tag] += 1
            self.never.append(self._never(tag, attrs))
            self.doubt.append(self._doubtful(tag, attrs))
            self.tag.append(tag)
            self.parent.append(top)
            self.inside.append(tag in WHOLE or self.inside[top])
            self.left_out.append(tag in INLINE or self.left_out[top])
            if not self.left_out[-1]:
                self.shown = self.open[-1]

    def _close(self) -> None:
        top = self.open[-1]
        if not self.left_out[top]:
            self.flush()
            self.shown = self.parent[top]
        self.open_tags[self.tag[self.open.pop()]] -= 1

    def _never(self, tag: str, attrs: list[tuple[str, str | None]]) -> bool:
        if self.never[self.open[-2]] or tag in NEVER:
            return True
        return tag not in ("html", "body", *WHOLE) and any(k == "hidden" or (k == "aria-hidden" and v == "true") for k, v in attrs)

    def _doubtful(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """The name by which an element holds no article, as far as its start tells."""
        if tag in ("html", "body", *WHOLE):
            return ""
        inside = self.inside[self.open[-2]]
        if tag == "form" or tag == "header" and not inside:
            return tag
        found = {_names(t) for k, v in attrs if k in ("class", "id") and v for t in v.split()} & NAMED
        if inside:  # the head of the article
            found -= {"header", "masthead"}
        if any(k == "role" and (v or "").lower() in ROLES for k, v in attrs):
            found.add("role")
        return min(found, key=lambda x: (x not in REPLIES, x), default="")

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if tag in CONTAINER and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCK and tag not in INLINE and not self.left_out[self.open[-1]]:
            self.flush()
        if tag in CONTAINER and self.open_tags[tag]:
            while self.tag[self.open[-1]] != tag:
                self._close()
            self._close()

    def _end_head(self) -> None:
        if self.tag[self.open[-1]] == "head":
            self._close()

    def handle_data(self, data: str) -> None:
        if not data.isspace():
            self._end_head()
        if not self.never[self.open[-1]]:
            self.parts.append(data)

    def read(self, html: str) -> list[tuple[str, int, int]]:
        last = html.rfind(">") + 1  # behind it no tag can end; browsers drop what begins there
        self.feed(html[:last] + _UNFINISHED.sub("", html[last:]))
        self.close()
        self.flush()
        return self.out

    def sums(self, nodes: list[int], values: list[float]) -> list[float]:
        """Of each container: the sum of the values that stand in it, at any depth."""
        out = [0.0] * len(self.tag)
        for n, v in zip(nodes, values, strict=True):
            out[n] += v
        for n in range(len(out) - 1, 0, -1):
            out[self.parent[n]] += out[n]
        return out

    def within(self, some: set[int]) -> list[bool]:
        """Of each container: whether it is one of these or lies in one."""
        out = [0 in some]
        for n in range(1, len(self.tag)):
            out.append(n in some or out[self.parent[n]])
        return out


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """Gaussian smoothing; the kernel is renormalised at both ends."""
    radius = int(np.ceil(3 * sigma))
    kernel = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    full = lambda x: np.convolve(x, kernel)[radius : radius + len(x)]
    return full(ratios) / full(np.ones(len(ratios)))


def main_text(html: str | None) -> str:
    """The article's blocks, joined by an empty line; empty for null, empty or text-less pages."""
    if not html:
        return ""
    page = _Lines()
    lines = page.read(html)
    if not lines:
        return ""
    size, prose = _prose(lines)
    if dropped := _dropped(page, [n for *_, n in lines], (size * prose).tolist()):
        out = page.within(dropped)
        kept, tags = [], 0
        for text, n, node in lines:  # the tags of what is left out stand before the next line
            tags += n
            if not out[node]:
                kept.append((text, tags, node))
                tags = 0
        lines = kept or lines
        size, prose = _prose(lines)
    inside = page.within({_region(page, [n for *_, n in lines], (size * prose).tolist())})
    return "\n\n".join(t for t, _, node in lines if inside[node])


def _prose(lines: list[tuple[str, int, int]]) -> tuple[np.ndarray, np.ndarray]:
    """(size, whether it is prose) of each line."""
    size = np.array([len(t) for t, *_ in lines], float)
    ratio = smoothed(size / np.maximum([n for _, n, _ in lines], 1))
    return size, ratio >= min(SPREAD * ratio.std(), ratio.max())


def _dropped(page: _Lines, nodes: list[int], weight: list[float]) -> set[int]:
    """The doubtful elements that are left out.

    Kept is one that encloses an article or main, or holds most of the prose. Where an
    article or main stands clear of all doubtful ones, those beside it enclose or hold
    other things, as do comments below it.
    """
    doubt = {n for n, name in enumerate(page.doubt) if name}
    if not doubt:
        return set()
    doubtful = page.within(doubt)
    held, has = page.sums(nodes, weight), page.sums(nodes, [1.0] * len(nodes))
    around = page.sums(nodes, [float(page.inside[n]) for n in nodes])
    doubt = {n for n in doubt if has[n]}
    if any(w and page.inside[n] and not doubtful[n] for n, w in zip(nodes, weight, strict=True)):
        kept = {n for n in doubt if page.inside[page.parent[n]] and 2 * held[n] > held[0] and page.doubt[n] not in REPLIES}
    else:
        kept = {n for n in doubt if around[n] and not page.inside[n] or 2 * held[n] > held[0]}
    return doubt - kept


def _region(page: _Lines, nodes: list[int], weight: list[float]) -> int:
    """The container whose lines are the text, from each line's container and size (0 if it isn't prose)."""
    some = [w > 0 for w in weight]
    whole = sum(w for n, w in zip(nodes, weight, strict=True) if page.inside[n])
    if 2 * whole > sum(weight):
        some = [x and page.inside[n] for n, x in zip(nodes, some, strict=True)]
    count = page.sums(nodes, list(map(float, some)))
    # the containers around all of the prose, from the outermost
    common = [n for n in range(1, len(count)) if count[n] == count[0] > 0]
    for n in common:
        if page.tag[n] in WHOLE:
            return n
    region = 0
    for n in common:
        if page.tag[n] not in REGION:
            break
        region = n
    return region


def extract(pages: DataFrame) -> DataFrame:
    """page_id, url, text and n_chars of every row of pages(page_id, url, html).

    Rows are read one by one: repeated rows and null ids stay, other columns are
    ignored, whatever their names.
    """
    ship(pages.sparkSession)
    pages = pick(pages, "page_id", "url", "html")
    schema = T.StructType([*pages.schema.fields[:2], T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                texts = pa.array([main_text(h) for h in part.column(2).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), texts], ["page_id", "url", "text"])

    return pages.mapInArrow(run, schema).withColumn("n_chars", F.length("text").cast("long"))
