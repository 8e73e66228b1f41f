"""Main text of web pages: parser events, text-to-tag ratio per line, Gaussian smoothing, threshold clustering.

A page is read as a stream of parser events.  Every block of text is a line with its number of characters and tags; the
smoothed ratio of both tells content from furniture, and runs of content lines form clusters.  All lines from the first
cluster to the last are the article, short ones, lists and tables too, but for elements that are furniture by name.
Article and main elements count as clusters with all they hold.  Before the first and after the last cluster, a page
with such an element ends; on any other page the rest stays too, but for menus (blocks of short links).

A class or id that names furniture hides its element only if that leaves the page its text: html, body, main and article
are never hidden by name, nor are containers of one such name with most of the text of high ratio (``unnamed``).  Names
of reader comments always hide, an article too where another one holds text outside it.

A line knows its innermost element and an element its parent, so a page takes time in proportion to its length, however
deep its elements nest and whatever is left open.

Defined cases: null, empty and text-free pages give an empty text; a page cut inside a tag loses that tag; unclosed
elements end with their parent or the page; declarations that are none are comments up to the next ``>``; repeated rows each get a row; an empty table gives no rows.  Extra columns
are not read.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from html.parser import HTMLParser

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crestline.llm.common import read, whole_text

#: Width of the smoothing in lines.
SIGMA = 1.5
#: A menu outside the clusters: least number of links, least share of its text in links, most characters of a link on average.
MENU_LINKS, MENU_SHARE, MENU_CHARS = 3, 0.8, 25

# fixed values: elements of the markup language by their role
SILENT = frozenset("script style noscript template head title svg math iframe object canvas audio video select textarea".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark q rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split()
)
NAMED = re.compile(
    r"(?:^|[\s_-])(?:ad|ads|advert|adverts|advertisement|advertising|banner|sponsor|sponsored|promo|promotion|nav|navbar|navigation|menu|breadcrumb|"
    r"breadcrumbs|sidebar|side-bar|aside|footer|header|masthead|cookie|cookies|consent|notice|notices|popup|modal|newsletter|subscribe|signup|login|"
    r"share|sharing|social|related|recommended|comment|comments|disqus|replies|widget|toolbar|pagination|pager|skip-link|"
    r"site(?:header|footer|nav|menu)|page(?:header|footer)|ad(?:box|unit|slot|wrap|wrapper|container|space|zone|banner)|"
    r"comments?(?:list|box|section|area|thread|form|wrap|wrapper|container)|(?:user|reader)comments?)(?:$|[\s_-])",
    re.I,
)
# names of reader comments
COMMENTS = re.compile(r"(?:user|reader)?comments?|disqus|replies|comments?(?:list|box|section|area|thread|form|wrap|wrapper|container)")
CAMEL = re.compile(r"(?<=[a-z0-9])(?=[A-Z])")
#: Named containers nested deeper than this count as of this depth.
NAME_DEPTH = 8
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert form menu menubar toolbar".split())
# elements that an opening tag of the same kind closes, up to the nearest list, table or section
SELF_CLOSING = {
    "p": {"p"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "td", "th"}, "td": {"td", "th"}, "th": {"td", "th"}, "option": {"option"},
}
SCOPES = frozenset("ul ol dl table tbody thead section article main div body html td blockquote".split())
ARTICLES = frozenset(("article", "main"))
UNNAMEABLE = ARTICLES | {"html", "body"}
# names that say what a page has, not what the element is
LAYOUT = re.compile(r"(?<!\S)(?:no|has|with|without)[_-]\S*", re.I)
CUT = re.compile(r"<(?:/?|[/!?]?[A-Za-z!-][^<>]*)\Z")
SPACES = re.compile(r"\s+")


@dataclass
class Line:
    """A block's text, with the tags met since the last block, the innermost element that holds it, its links and their
    characters, and the innermost of its elements that is furniture by class or id (0: none)."""

    text: str
    tags: int
    at: int
    links: int = 0
    linked: int = 0
    named: int = 0


class Lines(HTMLParser):
    """Turns events into lines, leaving out furniture but for what is furniture by class or id alone."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.lines: list[Line] = []
        self.open: list[tuple[str, int, bool]] = []  # name, number, hidden
        self.places: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
        # of every element by its number, 0 for the page: its parent and the innermost article or main that holds it
        self.parent: list[int] = [0]
        self.article: list[int] = [0]
        self.text: list[str] = []
        self.named = 0  # innermost open element that is furniture by class or id
        self.above: dict[int, int] = {0: 0}  # the next such element around it
        self.words: dict[int, tuple[int, str]] = {}  # how many such elements hold it, and the name that was found
        self.seen: dict[int, int] = {}  # tags since the last block, apart for each such element
        self.in_link = False
        self.links = self.linked = 0

    def parse_marked_section(self, i: int, report: int = 1) -> int:
        try:
            return super().parse_marked_section(i, report)
        except AssertionError:  # no section that the standard library knows
            return self.parse_bogus_comment(i)

    def _end_line(self) -> None:
        text = SPACES.sub(" ", "".join(self.text)).strip()
        self.text = []
        if text:
            self.lines.append(Line(text, self.seen.pop(self.named, 0), self.open[-1][1] if self.open else 0, self.links, self.linked, self.named))
            self.links = self.linked = 0

    def _tag(self) -> None:
        if not self.hidden:
            self.seen[self.named] = self.seen.get(self.named, 0) + 1

    def _close(self, k: int) -> None:
        """Close the open elements from place k on."""
        for name, number, _ in reversed(self.open[k:]):
            self.places[name].pop()
            if self.named == number:
                self.named = self.above[number]
        del self.open[k:]

    @property
    def hidden(self) -> bool:
        return bool(self.open) and self.open[-1][2]

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "br":
            self.text.append(" ")
        if tag in VOID:
            if tag not in INLINE and tag != "br":
                self._end_line()
            self._tag()
            return
        if tag == "a":
            self.in_link = any(name == "href" for name, _ in attrs)
            self.links += self.in_link and not self.hidden
        if tag in INLINE:  # inline elements neither hold lines nor, unless they are furniture, end them
            named = dict(attrs)
            if not self._furniture(named) and not self._named(named):
                self._tag()
                return
        else:
            self._end_line()
        if tag in SELF_CLOSING:
            self._close_like(SELF_CLOSING[tag])
        named = dict(attrs)
        hidden = self.hidden or tag in SILENT or tag in FURNITURE or self._furniture(named)
        number, up = len(self.parent), self.open[-1][1] if self.open else 0
        self.parent.append(up)
        self.article.append(number if tag in ARTICLES else self.article[up])
        word = "" if hidden else self._named(named)
        if word and (tag not in UNNAMEABLE or tag in ARTICLES and COMMENTS.fullmatch(word)):
            self._end_line()
            self.above[number] = self.named
            depth = min(self.words[self.named][0] + 1, NAME_DEPTH) if self.named else 0
            self.words[number] = (depth, word)
            self.named = number
        self.places[tag].append(len(self.open))
        self.open.append((tag, number, hidden))
        self._tag()

    @staticmethod
    def _furniture(named: dict[str, str | None]) -> bool:
        if not named:
            return False
        style = (named.get("style") or "").replace(" ", "").lower()
        return (
            "hidden" in named
            or (named.get("aria-hidden") or "").lower() == "true"
            or "display:none" in style
            or (named.get("role") or "").lower() in ROLES
        )

    @staticmethod
    def _named(named: dict[str, str | None]) -> str:
        """The name of furniture in class or id, or nothing."""
        marks = f"{named.get('class') or ''} {named.get('id') or ''}"
        found = NAMED.search(LAYOUT.sub(" ", CAMEL.sub("-", marks))) if marks.strip() else None
        return found[0].strip(" \t\n\r\f_-").lower() if found else ""

    def _last(self, names: Iterable[str]) -> int:
        return max((self.places[n][-1] for n in names if self.places.get(n)), default=-1)

    def _close_like(self, kinds: set[str]) -> None:
        k = self._last(kinds)
        if k >= 0 and k >= self._last(SCOPES):
            self._close(k)

    def handle_endtag(self, tag: str) -> None:
        self.in_link &= tag != "a"
        if tag not in INLINE:
            self._end_line()
        if self.places.get(tag):
            self._end_line()
            self._close(self.places[tag][-1])
        self._tag()

    def handle_data(self, data: str) -> None:
        if not self.hidden:
            self.text.append(data)
            self.linked += len(data.strip()) if self.in_link else 0

    def finish(self) -> list[Line]:
        self.close()
        self._end_line()
        return self.lines


def content_lines(lines: list[Line]) -> np.ndarray:
    """Lines of high smoothed text-to-tag ratio: above the threshold that best parts the ratios in two clusters."""
    ratio = np.array([len(x.text) / (1 + x.tags) for x in lines], float)
    reach = int(3 * SIGMA)
    kernel = np.exp(-0.5 * (np.arange(-reach, reach + 1) / SIGMA) ** 2)
    around = np.convolve(np.ones(len(ratio)), kernel, "full")[reach : reach + len(ratio)]
    smooth = np.convolve(ratio, kernel, "full")[reach : reach + len(ratio)] / around
    level = np.sort(np.log1p(smooth))
    if len(level) < 3 or level[-1] - level[0] < 0.5:
        return np.ones(len(ratio), bool)
    n = np.arange(1, len(level))
    low, total = np.cumsum(level)[:-1], level.sum()
    between = n * (len(level) - n) * (low / n - (total - low) / (len(level) - n)) ** 2
    cut = int(between.argmax())
    return np.log1p(smooth) > (level[cut] + level[cut + 1]) / 2


def _chain(parent: list[int], e: int) -> set[int]:
    """The element and all that hold it."""
    out = {e}
    while e:
        e = parent[e]
        out.add(e)
    return out


def _common(parent: list[int], a: int, b: int) -> int:
    """The innermost element that holds both; numbers rise inwards."""
    while a != b:
        if a > b:
            a = parent[a]
        else:
            b = parent[b]
    return a


def unnamed(lines: list[Line], parser: Lines) -> list[Line]:
    """``lines`` without those in furniture by class or id.

    Reader comments always go.  Containers of another name (at one depth of such containers) stay if together they hold
    over half of the page's text of high ratio and no article or main element beside them holds any text.  Where those
    that go have over half and no such element is left, these names tell nothing and all but the comments stay.
    """
    if not any(x.named for x in lines):
        return lines
    lines = _without_comments(lines, parser)
    size = np.array([len(x.text) for x in lines], float) * content_lines(lines) if lines else np.zeros(0)
    groups: dict[tuple[int, str], set[int]] = defaultdict(set)
    for e in {x.named for x in lines}:
        while e and e not in groups.get(parser.words[e], ()):
            groups[parser.words[e]].add(e)
            e = parser.above[e]
    gone: set[int] = set()
    for _, own in sorted(groups.items(), key=lambda g: (g[0][0], min(g[1]))):
        held_by, lost = _within(own, parser), _within(gone, parser)
        inside = np.array([held_by[x.named] and not lost[x.named] for x in lines])
        if not inside.any():
            continue
        ends = [x.at for x, held in zip(lines, inside) if held]
        around = _chain(parser.parent, _common(parser.parent, ends[0], ends[-1]))
        beside = any(
            parser.article[x.at] and parser.article[x.at] not in around for x, held in zip(lines, inside) if not held and (not x.named or x.named in around)
        )
        if beside or size[inside].sum() <= size.sum() / 2:
            gone |= own
    lost = _within(gone, parser)
    stays = np.array([not lost[x.named] for x in lines], bool)
    left = [x for x, stay in zip(lines, stays) if stay]
    return left if size[stays].sum() >= size.sum() / 2 or any(parser.article[x.at] for x in left) else lines


def _within(own: set[int], parser: Lines) -> dict[int, bool]:
    """For every named element whether it is one of ``own`` or lies in one."""
    out = {0: False}
    for e in sorted(parser.words):
        out[e] = e in own or out[parser.above[e]]
    return out


def _without_comments(lines: list[Line], parser: Lines) -> list[Line]:
    """``lines`` without reader comments; an article of that name goes only where another article holds text."""
    comments = {e for e, (_, word) in parser.words.items() if COMMENTS.fullmatch(word)}
    plain = {e for e in comments if parser.article[e] != e}
    lost = _within(comments, parser)
    if not any(parser.article[x.at] and not lost[x.named] for x in lines):
        lost = _within(plain, parser)
    return [x for x in lines if not lost[x.named]]


def main_text(html: str | None) -> str:
    """The article of one page: its blocks in order, joined by a space."""
    parser = Lines()
    parser.feed(CUT.sub("", html or ""))
    lines = unnamed(parser.finish(), parser)
    if not lines:
        return ""
    chosen = content_lines(lines)
    marked = np.array([parser.article[x.at] > 0 for x in lines])
    # smoothing lifts what lies beside a long text, so a line of short links begins or ends no cluster
    links = np.array([x.linked >= MENU_SHARE * len(x.text) and 0 < x.linked <= MENU_CHARS * x.links for x in lines])
    core = np.nonzero(chosen & ~links | marked)[0]
    first, last = (int(core[0]), int(core[-1])) if len(core) else (0, len(lines) - 1)
    kept = lines[first : last + 1]
    if not marked.any():
        inside = np.zeros(len(parser.parent), bool)
        for x in kept:
            e = x.at
            while not inside[e]:
                inside[e] = True
                e = parser.parent[e]
        kept = [*_without_menus(lines[:first], inside, parser.parent), *kept, *_without_menus(lines[last + 1 :], inside, parser.parent)]
    return " ".join(x.text for x in kept)


def _without_menus(lines: list[Line], inside: np.ndarray, parent: list[int]) -> list[Line]:
    """Lines outside the clusters, without the largest elements of theirs (none in ``inside``) that are menus."""
    if not lines:
        return lines
    sums = np.zeros((len(parent), 3), np.int64)
    for x in lines:
        sums[x.at] += (x.links, x.linked, len(x.text))
    for e in range(len(parent) - 1, 0, -1):
        if not inside[e]:
            sums[parent[e]] += sums[e]
    n, linked, size = sums.T
    menu = ~inside & (n >= MENU_LINKS) & (linked >= MENU_SHARE * size) & (linked <= MENU_CHARS * n)
    menu[0] = False
    for e in range(1, len(parent)):
        menu[e] |= menu[parent[e]]
    return [x for x in lines if not menu[x.at]]


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every row of ``pages``."""

    def texts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [main_text(html) for html in batch["html"]]
            yield pd.DataFrame(
                {"page_id": batch["page_id"].astype("Int64"), "url": batch["url"], "text": found, "n_chars": [len(t) for t in found]}
            )

    source = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", whole_text("html").alias("html"))
    return source.mapInPandas(texts, "page_id long, url string, text string, n_chars long")


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(read(spark, sf_dir, "pages"))


QUERIES = {"op10_html_extraction": op10_html_extraction}
ORACLE: dict[str, str] = {}
