"""Main text of HTML pages by text-to-tag ratio.

Parser events of the standard library are read once from front to back. They make lines,
one for each block, with their text, the number of tags in them and the sections they lie
in. The ratio of text to tags, smoothed along the page by a Gaussian, tells content from
the rest: lines above a threshold seed the content. The region then is every article or
main element that holds seeds, with the lines outside that reach the threshold alone. On
pages without those, the seeds are clustered in two by their own ratio; the region is the
smallest element around the upper ones, with headings among the seeds and paragraphs
outside that reach the threshold alone. Seeds that are mostly links widen nothing. Lines in parts that are marked as something else (menus, headers,
footers, sidebars, notices, adverts, forms, comments) never count.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import portions
from .workers import ship, tidy

#: Elements that begin and end a line.
_BLOCKS = frozenset("""
    address article aside blockquote body caption center dd details dialog dir div dl dt
    fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li
    main menu nav ol optgroup option p pre search section summary table tbody tfoot thead tr
    ul""".split())
#: Blocks that may be left open and hold no sections.
_LOOSE = frozenset("p dt dd li hr tr option optgroup".split())
#: White space between words.
_SPACES = frozenset("br td th wbr".split())
#: Elements without text for readers.
_SILENT = frozenset("""
    applet audio button canvas datalist embed head iframe math noframes noscript object
    script select style svg template textarea title video""".split())
_VOID = frozenset("""
    area base br col embed hr img input link meta param source track wbr""".split())
#: Sections that are no main text.
_APART = frozenset("nav header footer aside form dialog menu search fieldset".split())
#: A class, id or role of these words alone marks an element as no main text, but neither
#: an article or main element in it, nor an element that holds most of the seeds' text.
_MARKS = frozenset("""
    ad ads advert adverts advertisement advertising sponsor sponsored promo promotion
    banner billboard nav navbar navigation menu menubar breadcrumb breadcrumbs toc header
    masthead topbar toolbar footer bottombar copyright sidebar aside complementary
    contentinfo widget widgets related recommended recommendations share sharing social
    cookie cookies consent gdpr notice notification popup modal overlay dialog newsletter
    subscribe subscription signup login search form pagination pager comment comments
    commentlist respond replies disqus discussion reactions hidden noprint sr""".split())
#: Further whole names that mark an element.
_NAMES = frozenset("""
    sr-only visually-hidden screen-reader-text site-header site-footer site-nav
    site-navigation main-nav main-navigation main-menu nav-bar nav-menu nav-links
    menu-item widget-area cookie-bar cookie-banner share-buttons social-links
    related-posts related-articles login-form search-form page-footer""".split())
#: On these only the names for reader comments count, which also mark articles in them.
_TRUNKS = frozenset("html body main article".split())
_COMMENTS = frozenset("comment comments commentlist replies respond disqus discussion".split())
_COMMENT_NAMES = frozenset("""
    comment-list comments-list comments-area comment-area comment-section comments-section
    comment-thread comments-thread comment-body comment-content comment-respond
    comment-form disqus_thread""".split())
#: Elements that only hold others; text right in them may be anything.
_PLAIN = frozenset("html body div section center main article".split()) | {""}
_HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
_WORD = re.compile(r"[a-z]+")
#: Decimal references beyond all code points, which have too many digits to be read.
_BIG_NUMBER = re.compile(r"&#0*[1-9][0-9]{7,};?")


@dataclass(frozen=True)
class Settings:
    """Width of the smoothing in lines, and the part of the spread that content must reach."""

    sigma: float = 1.0
    radius: int = 3
    level: float = 0.5

    def kernel(self) -> list[float]:
        weights = [math.exp(-d * d / (2 * self.sigma ** 2))
                   for d in range(-self.radius, self.radius + 1)]
        return [w / sum(weights) for w in weights]


@dataclass
class Section:
    """An element that can hold lines; a mark by name is judged when the page is read."""

    tag: str
    parent: Section | None
    apart: bool
    enter: int
    named: bool = False
    trunk: Section | None = None  # the outermost article or main element around it
    leave: int = 0  # sections within have numbers from enter up to this

    def __post_init__(self):
        if self.parent is not None:
            self.trunk = self.parent.trunk
        if self.trunk is None and self.tag in ("article", "main"):
            self.trunk = self

    def holds(self, other: Section) -> bool:
        return self.enter <= other.enter < self.leave


@dataclass
class Line:
    section: Section
    apart: bool
    parts: list[str] = field(default_factory=list)
    tags: int = 0
    linked: int = 0
    text: str = ""
    bare: bool = True  # not in a paragraph or list item

    def ratio(self) -> float:
        """Characters outside links for each tag."""
        return (len(self.text) - min(self.linked, len(self.text))) / max(1, self.tags)


class _Open:
    """Open elements, innermost last; a tag that is not open is known without a search."""

    def __init__(self):
        self._tags: list[str] = []
        self._count: Counter[str] = Counter()

    def __len__(self) -> int:
        return len(self._tags)

    def push(self, tag: str) -> None:
        self._tags.append(tag)
        self._count[tag] += 1

    def close(self, tag: str) -> bool:
        """Close the innermost element of a tag and all in it; false if none is open."""
        if not self._count[tag]:
            return False
        while self._tags[-1] != tag:
            self._pop()
        self._pop()
        return True

    def cut(self, size: int) -> None:
        """Close all but the outermost ``size`` elements."""
        while len(self._tags) > size:
            self._pop()

    def _pop(self) -> None:
        self._count[self._tags.pop()] -= 1

    def clear(self) -> None:
        self._tags.clear()
        self._count.clear()


class _Lines(HTMLParser):
    """The lines of a page in order, in time that grows with its length."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.sections = [Section("", None, False, 0)]
        self._section = self.sections[0]
        self._depths: Counter[str] = Counter()  # open sections by tag
        self._silent = _Open()
        self._inner = _Open()  # open marked elements that are no sections
        self._loose = ""  # the open marked block that holds no sections
        self._before = 0  # how many of the inner elements were open when it began
        self._links = 0
        self._unclosed = False  # no comment after this ends
        self._line = Line(self._section, False)

    def _new_line(self) -> None:
        self.lines.append(self._line)
        self._line = Line(self._section, self._section.apart or bool(self._inner)
                          or bool(self._loose))

    def _leave(self) -> None:
        self._section.leave = len(self.sections)
        self._depths[self._section.tag] -= 1
        self._section = self._section.parent

    def _marked(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        """How an element is marked: for good, by its name, or not at all."""
        found = ""
        for name, value in attrs:
            if name == "hidden":
                found = "hidden"
            elif name in ("class", "id", "role") and value:
                for token in value.lower().split():
                    words = set(_WORD.findall(token))
                    if token in _COMMENT_NAMES or words and words <= _COMMENTS:
                        return "" if tag in _HEADINGS else "comments"
                    if token in _NAMES or words and words <= _MARKS:
                        found = found or ("" if tag in _HEADINGS else "name")
            elif name == "aria-hidden" and value == "true":
                found = "hidden"
            elif name == "style" and value and "display:none" in value.replace(" ", ""):
                found = "hidden"
        return "" if tag in _TRUNKS else found

    def handle_starttag(self, tag, attrs):
        if self._silent:
            if tag in _SILENT and tag not in _VOID:
                self._silent.push(tag)
            elif tag == "body":  # an open head ends here
                self._silent.clear()
            else:
                return
        elif tag in _SILENT:
            if tag not in _VOID:
                self._silent.push(tag)
            return
        if tag == "a":
            self._links = 1
        if tag in _BLOCKS:
            if tag in _LOOSE:
                self._loose = ""
            marked = self._marked(tag, attrs) if attrs else ""
            if tag in _LOOSE:
                if marked and tag not in _VOID:
                    self._loose, self._before = tag, len(self._inner)
            else:
                self._inner.clear()
                self._loose = ""
                here = self._section
                self._section = Section(
                    tag, here, here.apart or tag in _APART or marked in ("hidden", "comments"),
                    len(self.sections), marked == "name")
                self.sections.append(self._section)
                self._depths[tag] += 1
            self._new_line()
            self._line.bare = tag not in _LOOSE
        else:
            if tag in _SPACES:
                self._line.parts.append(" ")
            elif attrs and tag not in _VOID and self._marked(tag, attrs):
                self._inner.push(tag)
                self._new_line()
        self._line.tags += 1

    def handle_startendtag(self, tag, attrs):
        if tag in _VOID or tag in _BLOCKS:
            self.handle_starttag(tag, attrs)
        if tag in _BLOCKS and tag not in _VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag):
        if self._silent:
            self._silent.close(tag)
            return
        if tag == "a":
            self._links = 0
        if tag == self._loose:
            self._loose = ""
            self._inner.cut(self._before)
            self._new_line()
        elif self._inner.close(tag):
            if len(self._inner) < self._before:
                self._loose = ""
            self._new_line()
        if tag in _BLOCKS:
            if tag not in _LOOSE and self._depths[tag]:
                while self._section.tag != tag:
                    self._leave()
                self._leave()
                self._inner.clear()
                self._loose = ""
            self._new_line()
        elif tag in _SPACES:
            self._line.parts.append(" ")
        self._line.tags += 1

    def handle_data(self, data):
        if not self._silent:
            self._line.parts.append(data)
            if self._links:
                self._line.linked += len(data)

    def parse_html_declaration(self, i):
        """Comments as usual; anything else that begins like a declaration is left out."""
        if self.rawdata.startswith("<!--", i):
            return self.parse_comment(i)
        end = self.rawdata.find(">", i + 2)
        return end + 1 if end >= 0 else -1

    def parse_comment(self, i, report=1):
        """Where one comment has no end, none after it has, and none is searched for."""
        if self._unclosed:
            return -1
        end = super().parse_comment(i, report)
        self._unclosed = end < 0
        return end

    def read(self, html: str) -> list[Line]:
        """All lines. What follows the last ``>`` has no tags and is read as text."""
        at = html.rfind(">") + 1
        self.feed(_BIG_NUMBER.sub("&#xFFFD;", html[:at]))
        if self.rawdata:
            self.close()
        if not self.cdata_elem:
            self.handle_data(unescape(_BIG_NUMBER.sub("&#xFFFD;", html[at:])))
        self._new_line()
        while self._section.parent is not None:
            self._leave()
        self._section.leave = len(self.sections)
        return self.lines


def _around(sections: list[Section]) -> Section:
    """The smallest element around all of the sections."""
    root = sections[0]
    for section in sections:
        while not root.holds(section):
            root = root.parent
    return root


def _seeds(lines: list[Line], settings: Settings) -> tuple[list[int], set[int]]:
    """The unmarked lines over the threshold, or all unmarked ones if none is.

    The second are those that reach the threshold without their neighbours.
    """
    usable = [i for i, line in enumerate(lines) if not line.apart]
    if not usable:
        return [], set()
    ratios = [0.0 if line.apart else line.ratio() for line in lines]
    kernel, radius = settings.kernel(), settings.radius
    padded = [0.0] * radius + ratios + [0.0] * radius
    smooth = [sum(w * padded[i + k] for k, w in enumerate(kernel))
              for i in range(len(ratios))]
    mean = sum(smooth) / len(smooth)
    spread = math.sqrt(sum((s - mean) ** 2 for s in smooth) / len(smooth))
    threshold = min(settings.level * spread, mean)
    return ([i for i in usable if smooth[i] >= threshold] or usable,
            {i for i in usable if ratios[i] >= threshold})


def _upper(values: list[float]) -> float:
    """The least value of the upper of two clusters whose means are farthest apart.

    Of all cuts of the ordered values it is the one with the least squares within both;
    equal values are one cluster.
    """
    ordered = sorted(values)
    n, total = len(ordered), sum(ordered)
    best, cut, below = 0.0, ordered[0], 0.0
    for k in range(1, n):
        below += ordered[k - 1]
        if ordered[k] > ordered[k - 1]:
            between = k * (n - k) * (below / k - (total - below) / (n - k)) ** 2
            if between > best:
                best, cut = between, ordered[k]
    return cut


def _set_apart(lines: list[Line], sections: list[Section], settings: Settings) -> None:
    """Mark the lines in elements marked by name that don't hold most of the seeds' text.

    Marks around the outermost article or main element say nothing of lines in it, and
    where such elements hold seeds, theirs are the ones that count.
    """
    if not any(s.named for s in sections):
        return
    held = [0] * len(sections)
    seeds = _seeds(lines, settings)[0]
    for i in [i for i in seeds if lines[i].section.trunk is not None] or seeds:
        held[lines[i].section.enter] += len(lines[i].text)
    # Sections have numbers in the order they begin, so the last ones are the inner ones.
    for section in reversed(sections[1:]):
        # An article's text is not held against the marks around it.
        if section.trunk is not section:
            held[section.parent.enter] += held[section.enter]
    total = sum(held[s.enter] for s in sections if s.parent is None or s.trunk is s)
    apart = [False] * len(sections)
    for section in sections[1:]:
        if section.trunk is not section:
            apart[section.enter] = apart[section.parent.enter] or (
                section.named and 2 * held[section.enter] <= total)
    for line in lines:
        line.apart |= apart[line.section.enter]


def main_text(html: str | None, settings: Settings = Settings()) -> str:
    """The main text of a page: its blocks, joined by two line feeds; empty if there is none."""
    if not html:
        return ""
    parser = _Lines()
    lines = []
    for line in parser.read(html):
        line.text = " ".join("".join(line.parts).split())
        if line.text:
            lines.append(line)
    _set_apart(lines, parser.sections, settings)
    seeds, strong = _seeds(lines, settings)
    if not seeds:
        return ""
    trunks: dict[int, Section] = {}
    for i in seeds:
        if (trunk := lines[i].section.trunk) is not None:
            trunks[trunk.enter] = trunk
    links = [2 * line.linked > len(line.text) for line in lines]
    sown = [i for i in seeds if not links[i]] or seeds
    chosen = strong.intersection(sown)
    inside = bytearray(len(parser.sections))
    if trunks:
        roots = list(trunks.values())
    else:
        # The upper of two clusters says where the text is; of the lower, lines right in a
        # division elsewhere are adverts and notices.
        cut = _upper([lines[i].ratio() for i in sown])
        root = _around([lines[i].section for i in sown if lines[i].ratio() >= cut])
        while root.tag not in _PLAIN:
            root = root.parent
        roots = [root]
        chosen = {i for i in chosen if lines[i].ratio() >= cut or not lines[i].bare
                  or lines[i].section.tag not in _PLAIN}
        chosen.update(i for i in sown if lines[i].section.tag in _HEADINGS)
    for root in roots:
        inside[root.enter:root.leave] = b"\1" * (root.leave - root.enter)
    first, last = min(sown), max(sown)
    return "\n\n".join(
        line.text for i, line in enumerate(lines)
        if not line.apart and (i in chosen or inside[line.section.enter])
        # Outside an article, lists of links around the seeds are menus.
        and (trunks or first <= i <= last or not links[i]))


_RESULT = T.StructType([T.StructField("text", T.StringType()),
                        T.StructField("n_chars", T.LongType())])


def text_column(spark, html: Column, settings: Settings = Settings()) -> Column:
    """Struct of ``text`` and ``n_chars`` (code points) for a column of pages."""
    ship(spark)

    @F.arrow_udf(_RESULT)
    def extract(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in tidy(batches):
            texts = [main_text(page, settings) for begin, end in portions(batch)
                     for page in batch[begin:end].to_pylist()]
            yield pa.StructArray.from_arrays(
                [pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
                names=["text", "n_chars"])

    return extract(html)


def extract_text(pages: DataFrame, *, html: str = "html", keep: tuple[str, ...] = (
        "page_id", "url"), settings: Settings = Settings()) -> DataFrame:
    """One row per page: the ``keep`` columns, ``text`` and ``n_chars``.

    Whole pages are read, very long ones too, in time that grows with their length. A null or empty page, one without tags' worth of text and one
    of elements for boilerplate alone give an empty text; text without any tag is its own main text.
    Repeated rows and null keys stay. Other columns are left out, so names cannot clash;
    an empty table gives an empty result. No shuffle; pages go to Python in portions.
    """
    return pages.select(*keep, text_column(
        pages.sparkSession, F.col(html), settings).alias("main")).select(
        *keep, F.col("main.text").alias("text"), F.col("main.n_chars").alias("n_chars"))
