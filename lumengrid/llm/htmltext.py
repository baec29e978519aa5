"""Main text of web pages from a stream of parser events.

The standard library's parser turns a page into blocks in page order, each with its text and the tags
that were met in it. The logarithm of the blocks' text-to-tag ratio is smoothed with a Gaussian, and a
threshold between its two clusters (two means in one dimension) selects the content regions, on every
page. Structure guides it by bounded factors on the smoothed ratio: FOR for blocks in an article or main
element, 1 / AGAINST for those in navigation, page headers, footers, asides, forms and containers named
as adverts, notices or comments, articles and sections in them included. A form or a container with such a name that
holds the page's content isn't boilerplate, and one that lacks its end tag ends where content begins. Blocks of one container (a division, section, cell or the body) are a region:
where most of its text is selected all its blocks are, so that short paragraphs and headings stay, but
for those that the factor against boilerplate puts in the lower cluster.

Nulls: a null page is empty. A page without text gives an empty string. Broken markup is read as far as
it goes; very long pages are read whole, in time that grows with their length. Blocks with equal scores
have the same verdict; repeated rows give repeated results, an empty table an empty one. A carried column
named text is replaced by the result.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from functools import lru_cache
from html.parser import HTMLParser

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from lumengrid.llm.common import map_text

BLOCKS = frozenset("address article aside blockquote body caption center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr html legend li main menu nav ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split())
#: Elements whose blocks are a region.
CONTAINERS = frozenset("article aside body details div footer form header main nav section td th".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Elements whose text is never shown as text of the page.
HIDDEN = frozenset("script style head title noscript template svg math iframe object canvas audio video select textarea button datalist".split())
BOILERPLATE = frozenset("nav aside footer form menu search dialog".split())
ROLES = frozenset("navigation banner contentinfo complementary search form alert alertdialog dialog menu menubar toolbar".split())
NAMES = frozenset(
    "ad ads adv advert adverts advertisement advertising sponsor sponsored promo promoted promotion banner cookie cookies consent gdpr notice notices newsletter subscribe subscription signup share sharing social related recommended recommendations "
    "sidebar menu nav navbar navigation breadcrumb breadcrumbs footer masthead comment comments commentary disqus respond replies reply popup modal overlay widget widgets pagination pager toolbar search login copyright legal disclaimer skip alert teaser tags".split()
)
#: What may be in a head, which any other start tag ends, and so does text.
HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes script style template".split())
#: Open elements that a start tag ends.
ENDED = {"p": ("p",), "li": ("li",), "dd": ("dd", "dt"), "dt": ("dd", "dt"), "td": ("td", "th"), "th": ("td", "th"), "tr": ("tr", "td", "th")}
_SPLIT = re.compile(r"[^a-z0-9]+")
#: Factors by which an article or main element raises a block's ratio and boilerplate lowers it.
FOR, AGAINST = 32, 256
#: Characters a tag of plain boilerplate and of prose.
BARE, PROSE = 1, 40


@lru_cache(maxsize=4096)
def _named(value: str) -> tuple[bool, bool]:
    """Whether a class, id or role names boilerplate, and whether it names a page header."""
    boilerplate = header = False
    for name in re.sub(r"([a-z])([A-Z])", r"\1-\2", value).lower().split():
        words = [w for w in _SPLIT.split(name) if w]
        if words and words[0] not in ("with", "has", "no", "without"):
            boilerplate |= any(w in NAMES for w in words)
            header |= "header" in words
    return boilerplate, header


class Suspect:
    """An element that its tag or name calls boilerplate: its text, content elements in it, how it ended."""

    __slots__ = ("outer", "sure", "size", "contents", "holds", "ended", "unclosed", "until")

    def __init__(self, outer: Suspect | None, sure: bool):
        self.outer, self.sure = outer, sure
        self.size = self.contents = 0
        self.ended: int | None = None  # blocks before the first content after its start
        self.holds = self.unclosed = False
        self.until = 0


class Blocks(HTMLParser):
    """Collects blocks: (text, tags, in content element, in boilerplate, number of the container).

    What is boilerplate is known at the end of the page only: `finish` judges the elements that a tag or name calls so.
    """

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.named: Counter = Counter()  # open elements by name
        self.inline: list[Counter] = [Counter()]  # open elements that are no blocks, since each open block
        self.containers = [0]  # numbers of the open containers
        self.seen = 0
        self.open: list[tuple[str, str]] = []  # element and what it adds: "", "hidden", "boilerplate" or "content"
        self.count = {"": 0, "hidden": 0, "boilerplate": 0, "content": 0}
        self.suspects: list[Suspect] = []  # open elements that are called boilerplate
        self.contents = 0  # content elements so far
        self.size = 0  # characters of all text
        self.evidence: set[str] = set()  # whether a main element, and an article or heading have been seen
        self.closed: list[Suspect] = []  # suspects in the order of their start
        self.found: list[tuple[str, int, bool, Suspect | None, int]] = []
        self.blocks: list[tuple[str, int, bool, bool, int]] = []
        self.parts: list[str] = []
        self.tags = 0

    def flush(self) -> None:
        text = " ".join("".join(self.parts).split()) if self.parts else ""
        if text:
            self.found.append((text, self.tags, self.count["content"] > 0, self.suspects[-1] if self.suspects else None, self.containers[-1]))
            self.tags = 0
            self.size += len(text)
            if self.suspects:
                self.suspects[-1].size += len(text)
        self.parts = []

    def finish(self) -> None:
        """Judge what is called boilerplate.

        An element that was never closed ends where the content after it begins. One that holds the page's content
        can't be boilerplate by a name or as a form: a third of the text with the first main element, or the first
        article or heading, or four fifths of the text where no content element lies outside of it.
        """
        self.flush()
        while self.open:
            self.pop()
        for s in self.closed:
            if s.unclosed and s.ended is not None:
                s.until = s.ended
            elif s.sure or not (s.size * 3 >= self.size and s.holds or s.size * 5 >= self.size * 4 and s.contents == self.contents):
                s.until = len(self.found)
            if s.outer:
                s.until = max(s.until, s.outer.until)
        for at, (text, tags, content, suspect, container) in enumerate(self.found):
            self.blocks.append((text, tags, content, suspect is not None and at < suspect.until, container))

    def kind(self, tag: str, attrs: list[tuple[str, str | None]]) -> str:
        if tag in HIDDEN:
            return "hidden"
        if tag in ("article", "main"):
            return "content"
        if tag in BOILERPLATE or tag == "header" and not self.count["content"]:
            return "boilerplate"
        for name, value in attrs:
            if name == "hidden" or name == "aria-hidden" and value == "true":
                return "hidden"
            if name == "style" and value and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value):
                return "hidden"
            if name == "role" and value:
                if value in ROLES:
                    return "boilerplate"
                if value in ("main", "article"):
                    return "content"
            if name in ("class", "id") and value and tag not in ("html", "body"):
                boilerplate, header = _named(value)
                if boilerplate or header and not self.count["content"]:
                    return "boilerplate"
        return ""

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.tags += 1
        self.leave_head(tag)
        if tag in BLOCKS:
            self.flush()
            if tag in ENDED:
                self.imply(tag)
        elif tag == "br":
            self.parts.append(" ")
        if tag not in VOID:
            kind = self.kind(tag, attrs)
            if kind == "content":
                if not self.count["content"]:
                    for suspect in reversed(self.suspects):
                        if suspect.ended is not None:
                            break
                        suspect.ended = len(self.found)
                self.contents += 1
                if self.suspects:
                    self.suspects[-1].contents += 1
            proof = "main" if tag == "main" else "article" if tag in ("article", "h1") and not self.named["header"] else ""
            if proof and proof not in self.evidence:
                self.evidence.add(proof)
                for suspect in self.suspects:
                    suspect.holds = True
            self.open.append((tag, kind))
            self.count[kind] += 1
            self.named[tag] += 1
            if kind == "boilerplate":
                self.suspects.append(Suspect(self.suspects[-1] if self.suspects else None, tag in BOILERPLATE and tag != "form" or tag == "header"))
                self.closed.append(self.suspects[-1])
            if tag in BLOCKS:
                self.inline.append(Counter())
            else:
                self.inline[-1][tag] += 1
            if tag in CONTAINERS:
                self.seen += 1
                self.containers.append(self.seen)

    def leave_head(self, tag: str) -> None:
        """Close a head that lacks its end tag, where the tag (or text, if empty) can't be in it."""
        if not self.count["hidden"] or tag in HEAD:
            return
        at = len(self.open) - 1
        while at >= 0 and self.open[at][0] == "noscript":
            at -= 1
        if at >= 0 and self.open[at][0] == "head" and (tag or at == len(self.open) - 1):
            while len(self.open) > at:
                self.pop(closed=True)

    def imply(self, tag: str) -> None:
        """Close what the start tag ends, as far as the nearest block around it."""
        if not any(self.named[name] for name in ENDED[tag]):
            return
        ended = ENDED[tag]
        for at in range(len(self.open) - 1, -1, -1):
            name = self.open[at][0]
            if name in ended:
                while len(self.open) > at:
                    self.pop(closed=len(self.open) == at + 1)
                if tag != "tr":
                    return
            elif name in BLOCKS and name not in ("p", "h1", "h2", "h3", "h4", "h5", "h6"):
                return

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag in VOID:
            self.handle_starttag(tag, attrs)
        else:  # HTML ignores the slash of other elements
            self.handle_starttag(tag, attrs)
            if tag in ("svg", "math", "iframe"):
                self.handle_endtag(tag)

    def pop(self, closed: bool = False) -> None:
        tag, kind = self.open.pop()
        self.count[kind] -= 1
        self.named[tag] -= 1
        if kind == "boilerplate":
            suspect = self.suspects.pop()
            suspect.unclosed = not closed
            if self.suspects:
                self.suspects[-1].size += suspect.size
                self.suspects[-1].contents += suspect.contents
        if tag in BLOCKS:
            self.inline.pop()
        else:
            self.inline[-1][tag] -= 1
        if tag in CONTAINERS:
            self.containers.pop()

    def handle_endtag(self, tag: str) -> None:
        self.tags += 1
        if tag in BLOCKS:
            self.flush()
        if not (self.named[tag] if tag in BLOCKS else self.inline[-1][tag]):
            return  # an inline end tag doesn't close blocks
        while self.open[-1][0] != tag:
            self.pop()
        self.pop(closed=True)

    def handle_data(self, data: str) -> None:
        if self.count["hidden"] and data.strip():
            self.leave_head("")
        if not self.count["hidden"]:
            self.parts.append(data)


def smooth(values: list[float], sigma: float = 1.0) -> list[float]:
    """Gaussian smoothing within 3 sigma, with the weights that are inside the page."""
    reach = math.ceil(3 * sigma)
    weights = [math.exp(-k * k / (2 * sigma * sigma)) for k in range(-reach, reach + 1)]
    out = []
    for at in range(len(values)):
        lo, hi = max(0, at - reach), min(len(values), at + reach + 1)
        w = weights[lo - at + reach : hi - at + reach]
        out.append(sum(x * y for x, y in zip(w, values[lo:hi], strict=True)) / sum(w))
    return out


def threshold(values: list[float]) -> float:
    """Middle between the means of the two clusters of the values."""
    low, high = min(values), max(values)
    for _ in range(30):
        cut = (low + high) / 2
        below, above = [v for v in values if v < cut], [v for v in values if v >= cut]
        if not below or not above:
            break
        new = sum(below) / len(below), sum(above) / len(above)
        if new == (low, high):
            break
        low, high = new
    return (low + high) / 2


def parse(html: str | None) -> Blocks:
    """The blocks of a page. A tag that never ends is text, a comment that never ends hides the rest."""
    html = html or ""
    end = html.rfind(">") + 1
    rest = html[end:].split("<!--", 1)[0].replace("<", "&lt;")
    parser = Blocks()
    parser.feed(html[:end] + rest)
    if parser.rawdata.startswith("<!--"):  # what the parser waits for is the end of a comment, which never comes
        parser.rawdata = ""
    parser.close()
    parser.finish()
    return parser


def main_text(html: str | None) -> str:
    blocks = parse(html).blocks
    return "\n\n".join(text for (text, *_), keep in zip(blocks, regions(blocks), strict=True) if keep)


def regions(blocks: list[tuple[str, int, bool, bool, int]], sigma: float = 1.0) -> list[bool]:
    """Which blocks are content.

    A block is selected if its smoothed log ratio, with the weight of its structure, reaches the clusters'
    threshold. A block of a character a tag and a paragraph of prose count as one block each, so that a page of only one
    kind of blocks has two clusters too. Then whole regions are taken. Where no block is selected, as on a page of a
    few words, all that isn't boilerplate is.
    """
    smoothed = smooth([math.log(len(text) / max(1, tags)) for text, tags, *_ in blocks], sigma)
    weights = [-math.log(AGAINST) if boilerplate else math.log(FOR) if content else 0.0 for _, _, content, boilerplate, _ in blocks]
    scores = [s + w for s, w in zip(smoothed, weights, strict=True)]
    cut = threshold([math.log(BARE), *scores, math.log(PROSE)])
    chosen = [score >= cut for score in scores]
    if not any(chosen):
        return [not boilerplate for _, _, _, boilerplate, _ in blocks]
    found: Counter = Counter()
    for (text, _, _, boilerplate, container), keep in zip(blocks, chosen, strict=True):
        if keep or not boilerplate:
            found[container] += len(text) if keep else -len(text)
    return [keep or not boilerplate and found[container] > 0 for (_, _, _, boilerplate, container), keep in zip(blocks, chosen, strict=True)]


def extract(pages: DataFrame, html: str = "html", carry: list[str] | None = None) -> DataFrame:
    """The carried columns (all but the page, if None) and `text`."""
    carry = [c for c in pages.columns if c != html] if carry is None else carry
    return map_text(pages, html, lambda: lambda texts: [[main_text(t) for t in texts]], [("text", T.StringType())], carry)
