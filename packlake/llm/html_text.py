"""Main text of web pages from text-to-tag ratios.

The standard library's parser streams events; they are gathered into lines, one for each block of text, with the tags
met in it and the container that it stands in. A line's ratio is its characters for each tag, less where elements or
names hint at menus, notices, comments and the like, more inside an article element. Ratios are smoothed with a Gaussian
over neighbouring lines and split into two clusters by a threshold half-way between their means. The upper cluster says
where the content is: its region is the smallest container that holds nearly all of its text, or the article around
that. Of the region the upper lines stay, and the lower ones between and beside them that no hint speaks against.
"""

from __future__ import annotations

import itertools
import math
import re
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose content is no text of the page.
DROPPED = frozenset(
    "head title script style noscript template button select textarea dialog iframe object svg canvas audio video map datalist".split()
)
#: Elements that mostly hold something else than the article; a header does where it stands outside of one.
ASIDE = frozenset("nav aside footer form fieldset menu".split())
#: Elements that stay inside a line of text.
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark math nobr output q rp rt ruby s samp "
    "small span strike strong sub sup time tt u var wbr img picture input".split()
)
#: Names in class, id or role of blocks that mostly are not the article.
NAMES = frozenset(
    "ad ads advert adverts advertisement advertising adsense adslot banner sponsor sponsored promo promotion sidebar aside nav "
    "navbar navigation menu menubar breadcrumb breadcrumbs footer complementary contentinfo masthead topbar comment comments "
    "commentlist disqus respond replies cookie cookies consent gdpr notice notices alert newsletter subscribe subscription "
    "signup share sharing social related recommended popup modal overlay widget toolbar pagination pager login search "
    "copyright disclaimer paywall teaser outbrain taboola discussion reactions feedback side rail announcement announcements "
    "notification notifications skip blogroll legal subnav dropdown".split()
)
#: Those of them that hold for an article element too: comments are often marked up as articles.
EVEN_ARTICLES = frozenset("comment comments commentlist replies related recommended teaser ad ads advert advertisement sponsored promo".split())
#: A new one of these ends an open one, up to the nearest of the others.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "option": ({"option"}, {"select"}),
}
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6".split())
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")
SIGMA = 1.0
#: What multiplies a line's ratio: names that hint at something else than the article, elements that do, and elements that
#: hint at the article.
AGAINST, FURNITURE, FOR = 0.1, 0.01, 2.0
#: Share of the upper cluster's text that the region must hold.
NEARLY_ALL = 0.8


class Container:
    """An open or closed element. Numbers follow page order, so what is inside has the numbers from n to end."""

    __slots__ = ("doubtful", "dropped", "end", "furniture", "n", "semantic", "tag", "within")

    def __init__(self, n: int, tag: str, above: Container | None, semantic: bool = False, dropped: bool = False, doubtful: bool = False):
        self.n, self.tag, self.semantic, self.end = n, tag, semantic, None
        self.dropped = dropped or (above is not None and above.dropped)
        #: By an element or name here or above, unless an article stands in between.
        self.doubtful = doubtful or (above is not None and above.doubtful and not semantic)
        #: By an element, that is, not by a name alone.
        self.furniture = tag in ASIDE or (above is not None and above.furniture and not semantic)
        #: Whether it is, or stands in, an article or main element that isn't doubtful itself.
        self.within = (semantic and not doubtful) or (above is not None and above.within and not doubtful)


class Line:
    __slots__ = ("inside", "linked", "tags", "text")

    def __init__(self, inside: Container):
        self.text: list[str] = []
        self.tags = 0
        self.linked = 0
        self.inside = inside


class _Events(HTMLParser):
    """Lines of a page, each with its text, the tags met in it and the container that it stands in."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.every = [Container(0, "", None)]
        self.open: list[Container] = self.every[:]
        self.places: dict[str, list[int]] = {}  # of each tag, where it is in `open`
        self.lines: list[Line] = []
        self.links = 0
        self.line = Line(self.open[0])

    def _break(self) -> None:
        tags = 0 if self.line.text else self.line.tags
        if self.line.text:
            self.lines.append(self.line)
        self.line = Line(self.open[-1])
        self.line.tags = tags

    def _close(self, at: int) -> None:
        """Close all that is open from a place on."""
        for c in self.open[at:]:
            self.places[c.tag].pop()
            c.end = len(self.every) - 1
        del self.open[at:]

    def _place(self, tags) -> int:
        return max((p[-1] for t in tags if (p := self.places.get(t))), default=0)

    def handle_starttag(self, tag, attrs):
        self.line.tags += 1
        if tag == "a":
            self.links = 1
        if tag in INLINE:
            return
        if tag in VOID:
            self._break()
            return
        if tag in ENDS:
            own, limit = map(self._place, ENDS[tag])
            if own > limit:
                self._close(own)
        self.links = 0
        if tag not in PARAGRAPHS:
            self.places.setdefault(tag, []).append(len(self.open))
            self.open.append(self._container(tag, attrs))
        self._break()

    def _container(self, tag, attrs):
        words, role, hidden = set(), "", False
        for k, v in attrs:
            if k in ("class", "id") and v:
                words.update(w.lower() for w in PARTS.findall(v))
            elif k == "role" and v:
                role = v.lower()
                words.add(role)
            elif k == "hidden" or (k == "aria-hidden" and v == "true") or (k == "style" and v and HIDDEN.search(v)):
                hidden = True
            elif k == "itemprop" and v and v.lower() == "articlebody":
                role = "main"
        above = self.open[-1]
        semantic = tag in ("article", "main") or role in ("main", "article")
        if semantic:
            doubtful = bool(words & EVEN_ARTICLES)
        else:
            doubtful = tag in ASIDE or (tag not in ("html", "body") and bool(words & NAMES))
            doubtful = doubtful or (not above.within and (tag == "header" or "header" in words) and tag not in ("html", "body"))
        made = Container(len(self.every), tag, above, semantic, hidden or tag in DROPPED, doubtful)
        self.every.append(made)
        return made

    def handle_endtag(self, tag):
        self.line.tags += 1
        if tag == "a":
            self.links = 0
        if tag in INLINE:
            return
        if self.places.get(tag):
            self._close(self.places[tag][-1])
        self._break()

    def handle_data(self, data):
        if data.strip():
            self.line.text.append(data)
            if self.links:
                self.line.linked += len(data)
        elif self.line.text:
            self.line.text.append(" ")

    def parse_marked_section(self, i, report=1):
        return self.parse_bogus_comment(i, report)

    def unknown_decl(self, data):
        pass


def lines_of(html: str) -> tuple[list[Line], list[Container]]:
    events = _Events()
    events.feed(html)
    events.close()
    events._break()
    events._close(1)
    events.every[0].end = len(events.every) - 1
    return events.lines, events.every


def smoothed(values: list[float], sigma: float = SIGMA) -> list[float]:
    """Gaussian means over neighbours up to three sigma away, with weights that sum to one at the ends too."""
    reach = max(1, math.ceil(3 * sigma))
    kernel = [math.exp(-d * d / (2 * sigma * sigma)) for d in range(reach + 1)]
    out = []
    for i in range(len(values)):
        lo, hi = max(0, i - reach), min(len(values), i + reach + 1)
        weights = [kernel[abs(i - j)] for j in range(lo, hi)]
        out.append(sum(w * v for w, v in zip(weights, values[lo:hi], strict=True)) / sum(weights))
    return out


def threshold(values: list[float]) -> float:
    """Half-way between the means of the two clusters that it makes."""
    at = sum(values) / len(values)
    for _ in range(50):
        low, high = [v for v in values if v < at], [v for v in values if v >= at]
        if not low:
            return at
        new = (sum(low) / len(low) + sum(high) / len(high)) / 2
        if abs(new - at) < 1e-9:
            break
        at = new
    return at


def upper_cluster(lines: list[Line], sizes: list[int]) -> list[bool]:
    """Which lines belong to the upper cluster of smoothed ratios. Hints weigh in before the smoothing; a doubtful line is
    not lifted by its neighbours, and a line that is mostly links is never in it."""
    hint = lambda c: FURNITURE if c.furniture else AGAINST if c.doubtful else FOR if c.within else 1
    ratios = [n / max(1, x.tags) * hint(x.inside) for x, n in zip(lines, sizes, strict=True)]
    values = [min(own, s) if x.inside.doubtful else s for x, own, s in zip(lines, ratios, smoothed(ratios), strict=True)]
    at = threshold(values)
    return [v >= at and 2 * x.linked <= n for v, x, n in zip(values, lines, sizes, strict=True)]


def region_of(lines: list[Line], sizes: list[int], upper: list[bool], every: list[Container]) -> Container:
    """The smallest container that holds nearly all text of the upper cluster, or the article or main element around it."""
    mass = [0] * len(every)
    for x, n, up in zip(lines, sizes, upper, strict=True):
        mass[x.inside.n] += n * up
    total = sum(mass)
    passed = [0, *itertools.accumulate(mass)]
    mass = [passed[c.end + 1] - passed[c.n] for c in every]
    best = max((c for c in every if mass[c.n] >= NEARLY_ALL * total), key=lambda c: c.n)
    around = [c for c in every if c.semantic and not c.doubtful and c.n <= best.n <= c.end]
    return max(around, key=lambda c: (c.tag == "article", c.n), default=best)


def main_text(html: str | None) -> str:
    """The main text of a page; empty if there is none."""
    if not html:
        return ""
    every_line, every = lines_of(html)
    lines = [x for x in every_line if not x.inside.dropped]
    if all(x.inside.furniture for x in lines):
        return ""
    texts = [" ".join("".join(x.text).split()) for x in lines]
    sizes = [len(t) for t in texts]
    upper = upper_cluster(lines, sizes)
    if not any(upper):
        upper = [True] * len(lines)
    best = region_of(lines, sizes, upper, every)
    inside = [i for i, x in enumerate(lines) if best.n <= x.inside.n <= best.end]
    good = [i for i in inside if upper[i]]
    first, last = good[0], good[-1]
    if best.semantic:  # all of an article but what is doubtful
        return " ".join(texts[i] for i in inside if texts[i] and (upper[i] or not lines[i].inside.doubtful))
    plain = {i for i in inside if not lines[i].inside.doubtful}
    if best.tag not in ("", "html", "body"):  # a container of the article's own
        first, last = inside[0], inside[-1]
    near = lambda i, j: i in plain and lines[i].inside is lines[j].inside and not lines[i].linked
    while near(first - 1, first):
        first -= 1
    while near(last + 1, last):
        last += 1
    stay = [i for i in inside if first <= i <= last and (upper[i] or (i in plain and 2 * lines[i].linked <= sizes[i]))]
    return " ".join(texts[i] for i in stay if texts[i])


def extract(df: DataFrame, html: str = "html", out: str = "main_text") -> DataFrame:
    """`df` with a string column `out`: the main text of the whole page.

    A null or empty page, or one without text, has an empty text. Pages are parsed as far as they go: unclosed and stray
    tags, odd declarations and endless nesting raise nothing; truncated pages lose nothing before the cut. Very long
    pages are read whole, in time about proportional to their length. Of regions that hold equally much the inner one
    counts. Repeated rows stay; an empty table gives an empty table; a column already named `out` is an error. Nothing
    is shuffled.
    """
    if out.lower() in {c.lower() for c in df.columns}:
        raise ValueError(f"the table already has a column {out}")

    def make():
        return lambda pages: [pa.array([main_text(p.as_py()) for p in pages], pa.string())]

    return common.map_arrow(df, [common.quoted(html).cast("string")], [(out, T.StringType())], make, df.columns)


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    pages = common.table(spark, sf_dir, "pages").select("page_id", "url", "html")
    found = extract(pages, out="main_text").drop("html")
    return found.select("page_id", "url", F.col("main_text").alias("text"), F.length("main_text").cast("long").alias("n_chars"))


QUERIES = {"op9_html_extraction": op9_html_extraction}
