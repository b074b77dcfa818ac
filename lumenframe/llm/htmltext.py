"""Main text of web pages: parser events to lines, text-to-tag ratios, Gaussian smoothing, threshold clustering.

The standard library's parser streams a page's events, from which lines (the texts of blocks) come
with the tags met since the line before and the characters outside links. Lines in menus, headers,
footers, sidebars, notices, adverts, forms and comments, told by their elements' names, classes and
roles, have the ratio 0. Ratios are smoothed over neighbouring lines, and the threshold between the
two clusters of smoothed ratios selects lines. The content region is the article, or else the
innermost section, that holds most of the selected text; where that is the whole page, the selected
runs of lines are the content.

What is defined for odd rows: null html is empty; a page without content has an empty text; unclosed
elements end where HTML lets them end; repeated rows are kept; an empty table gives an empty result;
columns besides the three are not looked at. White space is what ``str.split`` splits at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html.parser import HTMLParser

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, freed

#: Standard deviation of the smoothing in lines; share of the selected text that the region has to hold; most lines between two selected ones that belong to them.
SIGMA, MOST_OF, BRIDGE = 1.5, 0.8, 2
#: Bytes of text that are returned at once.
TOGETHER = 4 << 20
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav "
    "ol option p pre search section select summary table tbody tfoot thead title tr ul".split()
)
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTION = frozenset("article main section div td body html".split())
#: Elements that are no text of the page at all, and those that frame the article.
UNSEEN = frozenset("script style head title template noscript iframe object svg math canvas audio video select button textarea datalist input".split())
FRAME = frozenset("nav aside footer form dialog menu search fieldset".split())
FRAME_ROLES = frozenset("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
#: Words of a class or id that mark what frames the article; a word after no-, has- or with- says nothing.
FRAME_WORDS = frozenset(
    "ad ads adbox adslot adsense advert adverts advertisement advertisements advertising sponsor sponsors sponsored promo promos promotion promoted banner banners nav navs navbar navigation menu menus "
    "breadcrumb breadcrumbs sidebar sidebars aside rail widget widgets masthead header topbar footer copyright legal cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay "
    "newsletter subscribe subscription signup login search share sharing social comment comments commentlist disqus discussion respond reply replies related recommended recommendations teaser teasers pagination pager toolbar form paywall".split()
)
_DENIED = re.compile(r"\b(?:no|not|has|with|without)[-_]\w+", re.A)
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_WORD = re.compile(r"[a-z]+")
#: An open element of the first kind ends where one of the second begins.
ENDS = {"li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr"}, "th": {"td", "th", "tr"}, "option": {"option"}, "head": {"body"}}
#: Elements that an end tag or an implied end inside does not reach across.
BARRIER = frozenset("table ul ol dl td th article main section body html".split())


class Line:
    """A block's text; characters outside links; tags since the line before; ids of its sections, outermost first; whether it frames the article."""

    __slots__ = ("free", "frame", "sections", "tags", "text")

    def __init__(self, text: str, free: int, tags: int, sections: tuple[int, ...], frame: bool):
        self.text, self.free, self.tags, self.sections, self.frame = text, free, tags, sections, frame


class Lines(HTMLParser):
    """Collects a page's lines, and which sections are articles."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.kinds: list[str] = []
        self._open: list[tuple[str, bool, bool]] = []  # name, unseen, frame
        self._sections: list[int] = []
        self._unseen = self._frames = self._links = self._tags = self._headers = 0
        self._held: list[str] = []
        self._free = 0

    def _flush(self) -> None:
        if self._held:
            text = " ".join("".join(self._held).split())
            self._held.clear()
            if text:
                self.lines.append(Line(text, self._free, self._tags, tuple(self._sections), self._frames > 0 or self._header_line()))
                self._tags = 0
            self._free = 0

    def _header_line(self) -> bool:
        """In a header, all but headings of an article frame it."""
        if not self._headers:
            return False
        inside = any(self.kinds[s] == "article" or self.kinds[s] == "main" for s in self._sections)
        return not (inside and any(name in HEADING for name, _, _ in self._open))

    def handle_starttag(self, tag: str, attrs: list) -> None:
        self._tags += 1
        if self._unseen and tag not in ("body", "article", "main"):
            if tag not in VOID:
                self._push(tag, tag in UNSEEN, False)
            return
        self._end_before(tag)
        if tag in BLOCK:
            self._flush()
        elif tag in ("br", "td", "th"):
            self._held.append(" ")
        if tag in VOID:
            return
        if tag == "header":
            self._push(tag, False, False)
            return
        frame = tag in FRAME
        unseen = tag in UNSEEN
        if attrs and not (frame or unseen) and tag not in ("html", "body", "main"):
            frame, unseen = self._told(dict(attrs), tag)
        if frame and tag not in BLOCK:  # inside a line: only its own text goes
            frame, unseen = False, True
        self._push(tag, unseen, frame)

    def _told(self, attrs: dict, tag: str) -> tuple[bool, bool]:
        if "hidden" in attrs or "display:none" in (attrs.get("style") or "").replace(" ", "").lower():
            return False, True
        if (attrs.get("role") or "").lower() in FRAME_ROLES:
            return True, False
        told = f"{attrs.get('class') or ''} {attrs.get('id') or ''}"
        if told == " ":
            return False, False
        told = _DENIED.sub(" ", told)
        words = {*_WORD.findall(told.lower()), *_WORD.findall(_CAMEL.sub("-", told).lower())}
        if tag in HEADING or tag == "article":
            words -= {"header", "banner", "promoted", "legal", "alert", "notice"}
        return not words.isdisjoint(FRAME_WORDS), False

    def _push(self, tag: str, unseen: bool, frame: bool) -> None:
        self._open.append((tag, unseen, frame))
        self._unseen += unseen
        self._frames += frame
        self._links += tag == "a"
        self._headers += tag == "header"
        if tag in SECTION:
            self._sections.append(len(self.kinds))
            self.kinds.append(tag)

    def _pop(self) -> None:
        tag, unseen, frame = self._open.pop()
        self._unseen -= unseen
        self._frames -= frame
        self._links -= tag == "a"
        self._headers -= tag == "header"
        if tag in SECTION:
            self._sections.pop()

    def _end_before(self, tag: str) -> None:
        """What ``tag`` ends by beginning."""
        if not self._open:
            return
        if tag in ("article", "main", "body"):  # these stand in no menu or header
            for n, (name, _, _) in enumerate(self._open):
                if name in ("head", "nav", "header", "menu", "p", "script", "style") or (tag != "article" and name in FRAME):
                    self._close(n)
                    return
        if tag in BLOCK and tag != "option":
            for n in range(len(self._open) - 1, -1, -1):
                name = self._open[n][0]
                if name == "p" or (name in HEADING and tag in HEADING):
                    self._close(n)
                    break
                if name in BLOCK:
                    break
        for n in range(len(self._open) - 1, -1, -1):
            name = self._open[n][0]
            if name in ENDS and tag in ENDS[name]:
                self._close(n)
                return
            if name in BARRIER:
                return

    def _close(self, n: int) -> None:
        self._flush()
        while len(self._open) > n:
            self._pop()

    def handle_endtag(self, tag: str) -> None:
        self._tags += 1
        wall = BARRIER if tag not in BARRIER else ()
        for n in range(len(self._open) - 1, -1, -1):
            name = self._open[n][0]
            if name == tag:
                if tag in BLOCK:
                    self._flush()
                while len(self._open) > n:
                    self._pop()
                return
            if name in wall:
                return

    def handle_data(self, data: str) -> None:
        if self._unseen:
            return
        self._held.append(data)
        if not self._links:
            self._free += len(data) - data.count(" ")

    def unknown_decl(self, data: str) -> None:
        pass

    def done(self) -> None:
        self._flush()


def smoothed(ratios: np.ndarray, sigma: float = SIGMA) -> np.ndarray:
    """A Gaussian over neighbouring lines, up to three sigma, weights within the page summing to 1."""
    radius = int(3 * sigma)
    w = np.exp(-0.5 * (np.arange(-radius, radius + 1) / sigma) ** 2)
    sums = np.convolve(ratios, w)[radius : radius + len(ratios)]
    return sums / np.convolve(np.ones(len(ratios)), w)[radius : radius + len(ratios)]


def threshold(values: np.ndarray) -> float:
    """Between two clusters of ``values``: a lower and an upper mean, each value with the nearer one, halfway in roots, as ratios spread widely."""
    roots = np.sqrt(values)
    low, high = float(roots.min()), float(roots.max())
    for _ in range(50):
        cut = (low + high) / 2
        upper = roots >= cut
        if upper.all():
            break
        new = float(roots[~upper].mean()), float(roots[upper].mean())
        if new == (low, high):
            break
        low, high = new
    return ((low + high) / 2) ** 2


def main_lines(parsed: Lines) -> list[Line]:
    lines = parsed.lines
    if not any(not x.frame and x.free for x in lines):
        return [x for x in lines if not x.frame]
    ratios = np.array([0.0 if x.frame else x.free / max(1, x.tags) for x in lines])
    even = smoothed(ratios)
    chosen = (even >= threshold(even)) & np.array([not x.frame for x in lines])
    if not chosen.any():
        chosen = np.array([not x.frame and x.free > 0 for x in lines])
    weight: dict[int, int] = {}
    total = 0
    for x, c in zip(lines, chosen, strict=True):
        if c:
            total += x.free + 1
            for s in x.sections:
                weight[s] = weight.get(s, 0) + x.free + 1
    held = [s for s in weight if weight[s] >= MOST_OF * total]  # outermost first, as sections are numbered
    held.sort()
    declared = [s for s in held if parsed.kinds[s] == "article"] or [s for s in held if parsed.kinds[s] == "main"]
    region = declared[0] if declared else (held[-1] if held else None)
    if region is not None and parsed.kinds[region] not in ("body", "html"):
        inside = [(x, c) for x, c in zip(lines, chosen, strict=True) if region in x.sections and not x.frame]
        return [x for x, c in inside if declared or c or x.free * 2 >= len(x.text)]
    keep = set(np.flatnonzero(chosen).tolist())
    order = sorted(keep)
    for a, b in zip(order, order[1:], strict=False):
        if b - a <= BRIDGE + 1:
            keep.update(k for k in range(a + 1, b) if not lines[k].frame)
    first, last = order[0], order[-1]
    while first > 0 and not lines[first - 1].frame and lines[first - 1].free * 2 >= len(lines[first - 1].text) and first - 1 not in keep and order[0] - first < BRIDGE:
        first -= 1
        keep.add(first)
    while last + 1 < len(lines) and not lines[last + 1].frame and lines[last + 1].free * 2 >= len(lines[last + 1].text) and last - order[-1] < BRIDGE:
        last += 1
        keep.add(last)
    return [lines[k] for k in sorted(keep) if lines[k].free]


def main_text(html: str | None) -> str:
    """The main text of a page, a block a line."""
    parser = Lines()
    parser.feed(html or "")
    parser.close()
    parser.done()
    return "\n".join(x.text for x in main_lines(parser))


def extract_text(pages: DataFrame) -> DataFrame:
    """``page_id, url, text, n_chars`` of ``pages(page_id, url, html)``: each page where it lies, without any exchange."""
    bounded_batches(pages.sparkSession)
    schema = f"page_id {dict(pages.dtypes)['page_id']}, url string, text string, n_chars long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, size, texts = 0, 0, []
            for n, html in enumerate(batch.column(2)):
                texts.append(main_text(html.as_py()))
                size += len(texts[-1])
                if size > TOGETHER or n + 1 == batch.num_rows:
                    some = batch.slice(begin, len(texts))
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])
                    begin, size, texts = n + 1, 0, []

    return pages.select("page_id", F.col("url").cast("string"), F.col("html").cast("string")).mapInArrow(freed(run), schema)
