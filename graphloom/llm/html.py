"""Main text of web pages by two passes of block rules.

The markup is cut into blocks of text at block-level tags, in one pass over the page whose work grows
with its length only. The first pass decides a block by itself: link density, length and density of
stop words, and the regions that the markup names as menus, footers, adverts, comments and so on. What
it leaves open, short or middling blocks, the second pass gives the label of the nearest decided
neighbours: first of those in the same element, then of those around.

An element that the page names as its article is evidence, not the decision: prose outside it is left to
its neighbours, and neighbours across its border are farther away. Where a page's prose has few of the
listed stop words, its language isn't listed, and length and link density decide alone.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm._shared import frames

#: Common words of several languages; a text in one of them has many.
STOP_WORDS = frozenset(
    "the of and to in a is that it for on was be with as are by at this an from or have not but his her they you we which "
    "le la les de des du et un une en est que qui dans pour par sur au aux avec ce il elle ne pas plus son se sont "
    "der die das und den dem des ein eine einen ist in im von zu mit auf für nicht sich als auch es an er wie aus bei "
    "el los las del y una con por para se su al lo como más o pero sus le ha si "
    "il di che e non per una sono con si da come anche della nel "
    "o os um uma do da em não com mais dos das "
    "het een van op te dat niet zijn met voor".split()
)
LINK_DENSITY_MAX = 0.4
LENGTH_LOW, LENGTH_HIGH = 70, 200
STOPS_LOW, STOPS_HIGH = 0.15, 0.30
#: Elements whose content is never text of the page.
SKIP = frozenset("script style noscript template head iframe object embed applet svg math canvas audio video map select textarea button datalist title".split())
#: Elements that hold no article text, whatever their class.
CHROME = frozenset("nav header footer aside form menu dialog fieldset".split())
BLOCK = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 "
    "header hgroup hr html legend li main menu nav noframes ol optgroup option p pre search section summary table tbody td tfoot th thead tr ul".split()
)
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: An open element of the key ends where one of the values begins.
CLOSES = {"p": BLOCK - {"body", "html"}, "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "tr": {"tr", "tbody", "tfoot"}, "td": {"td", "th", "tr", "tbody", "tfoot"}, "th": {"td", "th", "tr", "tbody", "tfoot"}, "option": {"option", "optgroup"}, "h1": {"p"}, "h2": {"p"}, "h3": {"p"}}
#: Words of class, id and role that name a region outside the article.
OUTSIDE = frozenset(
    "ad ads advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promoted promotion banner nav navbar navigation menu menubar breadcrumb breadcrumbs "
    "header masthead topbar toolbar footer foot bottombar copyright legal sidebar side aside widget widgets rail related recommended recommendations popular trending teaser teasers "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay newsletter subscribe subscription signup login signin register paywall "
    "comment comments commentlist discussion disqus replies reply respond share sharing social follow tags tagcloud pagination pager search searchform form skip hidden "
    "contentinfo complementary dialog print".split()
)
#: A quoted value of over 99,999 characters ends its tag at the first >, so that no tag is looked for in vain again and again.
_TOKEN = re.compile(r"<!--.*?(?:-->|$)|<!\[CDATA\[.*?(?:\]\]>|$)|<[!?][^>]*>?|<(/?)([a-zA-Z][^\s/>]*+)((?>[^>\"']++|\"[^\"]{0,99999}+\"|'[^']{0,99999}+'){0,999})>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*)>", re.DOTALL)
_NAMED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+))", re.IGNORECASE)
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|$)|display\s*:\s*none|aria-hidden\s*=\s*[\"']?true", re.IGNORECASE)
_RAW = {t: re.compile(rf"</{t}\s*>", re.IGNORECASE) for t in ("script", "style", "textarea", "title", "noscript", "iframe", "template")}
_WORD = re.compile(r"\w+")
_PARTS = re.compile(r"[a-z]+")
#: Names that say what a region has or lacks, not what it is.
_ABOUT = re.compile(r"(?:^|(?<=\s))(?:has|with|without|no|not)[-_]\S*")
_CJK = re.compile("[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_RIGHTS = re.compile(r"\W{0,4}(?:©|\(c\)|copyright\b)(?:\W|\(c\)){0,4}\d{4}\b", re.IGNORECASE)
#: Elements that hold one block's text; its siblings are those of the element around.
LEAF = frozenset("p h1 h2 h3 h4 h5 h6 li dt dd td th caption figcaption summary pre address legend option".split())
HEADING = frozenset("h1 h2 h3 h4 h5 h6".split())
#: How much farther a neighbour across the border of the named article, or of a region outside it, is.
BORDER = 3


@dataclass
class Block:
    text: str
    link_chars: int
    outside: bool
    inside: bool  # of an element that the page says is its article
    heading: bool = False
    item: bool = False  # of a list
    parent: int = 0  # number of the element around
    flat: bool = True  # that is the page's body
    label: str = ""


def _outside(tag: str, attributes: str, inside: bool) -> bool:
    """Whether the element is a region outside the article; a header inside of it is the article's own."""
    if tag in CHROME and not (inside and tag == "header"):
        return True
    if not attributes:
        return False
    if _HIDDEN.search(attributes):
        return True
    named = {x for m in _NAMED.finditer(attributes) for x in _PARTS.findall(_ABOUT.sub("", "".join(g for g in m.groups() if g).lower()))}
    if tag in ("body", "html", "main", "article"):
        return tag == "article" and not named.isdisjoint({"comment", "comments", "reply", "teaser", "ad", "advert", "sponsored", "promo", "related"})
    return not named.isdisjoint(OUTSIDE - {"header"} if inside else OUTSIDE)


class _Open:
    """The open elements, with how many of each name there are since the last table or body, and which are blocks."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, bool, int]] = []  # tag, skipped, outside, inside, number
        self.counts: list[dict[str, int]] = [{}]
        self.blocks: list[int] = []  # places of block elements in the stack
        self.links = self.made = 0

    def push(self, tag: str, skipped: bool, outside: bool, inside: bool) -> None:
        self.made += 1
        if tag in BLOCK:
            self.blocks.append(len(self.stack))
        self.stack.append((tag, skipped, outside, inside, self.made))
        self.counts[-1][tag] = self.counts[-1].get(tag, 0) + 1
        if tag in ("table", "body"):
            self.counts.append({})
        self.links += tag == "a"

    def pop(self) -> str:
        tag = self.stack.pop()[0]
        if tag in ("table", "body"):
            self.counts.pop()
        self.counts[-1][tag] -= 1
        if self.blocks and self.blocks[-1] == len(self.stack):
            self.blocks.pop()
        self.links -= tag == "a"
        return tag

    def has(self, tag: str) -> bool:
        """Whether tag is open and an end tag may close it: not across a table or a body, unless it is one."""
        if tag in ("html", "body"):
            return any(c.get(tag) for c in self.counts)
        own = self.counts[-1].get(tag, 0)
        return bool(own or tag == "table" and len(self.counts) > 1 and self.counts[-2].get(tag))

    def state(self) -> tuple[bool, bool, bool]:
        return self.stack[-1][1:4] if self.stack else (False, False, False)


def blocks(page: str) -> list[Block]:
    """The page's blocks in order, character references decoded and white space made one space."""
    out: list[Block] = []
    open_ = _Open()
    stack, around = open_.stack, open_.blocks
    skipped = outside = inside = False
    parts: list[str] = []
    link_parts: list[str] = []
    broke = False
    at, size, last = 0, len(page), page.rfind(">")

    def flush() -> None:
        nonlocal broke
        broke = False
        if parts:
            text = " ".join("".join(parts).split())
            if text:
                own = stack[around[-1]][0] if around else ""
                up = around[-2] if own in LEAF and len(around) > 1 else around[-1] if around and own not in LEAF else -1
                tag, number = (stack[up][0], stack[up][4]) if up >= 0 else ("body", 0)
                out.append(Block(text, len(" ".join("".join(link_parts).split())), outside, inside, own in HEADING, own == "li", number, tag in ("body", "html")))
            parts.clear()
            link_parts.clear()

    def add(raw: str) -> None:
        nonlocal broke
        if raw and not skipped:
            text = entities.unescape(raw) if "&" in raw else raw
            parts.append(text)
            if open_.links:
                link_parts.append(text)
            if broke and not text.isspace():
                broke = False

    def close(tag: str) -> None:
        nonlocal skipped, outside, inside
        if not open_.has(tag):
            return
        flushed = False
        while True:
            if not flushed and stack[-1][0] in BLOCK:
                flush()
                flushed = True
            if open_.pop() == tag:
                break
        skipped, outside, inside = open_.state()

    while at < size:
        m = _TOKEN.search(page, at) if at <= last or page.find("<!", at) >= 0 else None
        if m is None:
            add(page[at:])
            break
        add(page[at : m.start()])
        at = m.end()
        tag = m[2] or m[5]
        if not tag:
            if m[0].startswith("<![CDATA["):
                add(m[0][9:].removesuffix("]]>").replace("&", "&amp;"))
            continue
        tag, closing, attributes = tag.lower(), m[1] or m[4], m[3] if m[2] else m[6]
        if closing:
            if tag == "br":
                add(" ")
            elif tag == "p" and not open_.has("p"):
                flush()
            else:
                close(tag)
            continue
        if tag == "br":
            if broke:
                flush()
            else:
                add("\n")
                broke = True
            continue
        if tag in BLOCK:
            flush()
        if tag in VOID:
            continue
        while stack and tag in CLOSES.get(stack[-1][0], ()):
            close(stack[-1][0])
        if tag in CLOSES["p"] and around and around[-1] < len(stack) - 1 and stack[around[-1]][0] == "p":
            close("p")  # an inline element left open, as in <p><b>text<p>, ends with its paragraph
        if tag in _RAW:
            end = _RAW[tag].search(page, at)
            at = end.end() if end else size
            continue
        if tag == "body":
            while open_.has("head"):
                close("head")
        skipped = skipped or tag in SKIP
        outside = outside or _outside(tag, attributes, inside)
        inside = inside or tag in ("article", "main") or 'role="main"' in attributes or 'itemprop="articleBody"' in attributes
        if not attributes.rstrip().endswith("/") or tag in BLOCK or tag in ("a", "span", "b", "i", "em", "strong"):
            open_.push(tag, skipped, outside, inside)
        else:
            skipped, outside, inside = open_.state()
    flush()
    return out


def _decide(found: list[Block]) -> bool:
    """The first pass: the label of each block that its own text decides. Whether the page names an article that has text."""
    length, stops, total, free = [], [], 0, 0
    for b in found:
        words = _WORD.findall(b.text.lower())
        count = sum(w in STOP_WORDS for w in words)
        length.append(len(b.text) + 2 * len(_CJK.findall(b.text)))
        stops.append(count / max(1, len(words)))
        if not b.outside and length[-1] >= LENGTH_LOW and b.link_chars <= LINK_DENSITY_MAX * len(b.text):
            total, free = total + count, free + len(words)
    listed = total >= STOPS_LOW * free  # the page's prose is in a language whose stop words are listed
    for b, n, share in zip(found, length, stops, strict=True):
        dense = b.link_chars / len(b.text)
        if b.outside or dense > LINK_DENSITY_MAX or not b.inside and n < LENGTH_HIGH and _RIGHTS.match(b.text):
            b.label = "bad"
        elif n < LENGTH_LOW:
            b.label = "bad" if dense > LINK_DENSITY_MAX / 2 else ""
        elif not listed or share >= STOPS_HIGH or share >= STOPS_LOW and n >= LENGTH_HIGH:
            b.label = "good"
    sizes = [sum(len(b.text) for b in found if b.label == "good" and b.inside is x) for x in (False, True)]
    named = sizes[1] > 0 and sizes[1] >= sizes[0]
    for b in found:
        if named and b.label == "good" and not b.inside:
            b.label = ""  # prose beside the article: its neighbours decide
    return named


def classify(found: list[Block]) -> None:
    """Give each block the label good or bad."""
    named = _decide(found)
    if not any(b.label == "good" for b in found):
        # nothing is sure: what isn't bad is all the text there is
        for b in found:
            b.label = b.label or "good"
        return
    n = len(found)
    before, after = [-1] * n, [n] * n  # nearest decided blocks; the page's ends count as bad
    kin_before, kin_after = [-1] * n, [n] * n  # and those of the same element
    near, seen = -1, {}
    for i, b in enumerate(found):
        before[i], kin_before[i] = near, seen.get(b.parent, -1)
        if b.label:
            near = seen[b.parent] = i
    near, seen = n, {}
    for i in range(n - 1, -1, -1):
        b = found[i]
        after[i], kin_after[i] = near, seen.get(b.parent, n)
        if b.label:
            near = seen[b.parent] = i
    label = lambda i: found[i].label if 0 <= i < n else "bad"

    def across(i: int, j: int) -> int:
        """BORDER if a border parts the blocks. None parts regions outside from menus or from what stands beside the article."""
        if not 0 <= j < n or found[j].outside and (found[i].item or named and not found[i].inside):
            return 0
        return BORDER if found[j].outside or found[i].inside != found[j].inside else 0

    given = [b.label for b in found]
    i = 0
    while i < n:
        z = i + 1
        if given[i]:
            i = z
            continue
        kin = not found[i].flat and (kin_before[i] >= 0 or kin_after[i] < n)
        if not kin and not found[i].heading:
            # open blocks of one element that has no decided block go together
            while z < n and not given[z] and found[z].parent == found[i].parent and not found[i].flat:
                z += 1
        x, y = (kin_before[i], kin_after[i]) if kin else (before[i], after[i])
        if kin and (x < 0 or y >= n):
            given[i] = label(x if x >= 0 else y)
        elif label(x) == label(y):
            given[i:z] = [label(x)] * (z - i)
        else:
            left, right = i - x + across(i, x), y - z + 1 + across(i, y)
            # a heading goes with what follows it; otherwise a tie keeps the text
            own = label(y) if found[i].heading and right <= left + 1 else label(x) if left < right else label(y) if right < left else "good"
            given[i:z] = [own] * (z - i)
        i = z
    for b, g in zip(found, given, strict=True):
        b.label = g


def main_text(page: str | None) -> str:
    """The blocks labelled good, joined in page order by two line ends."""
    if not page:
        return ""
    found = blocks(page)
    classify(found)
    return "\n\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars), one row per row of pages, in one pass without a shuffle.

    A null or empty html, or one without article text, gives an empty text; repeated rows stay
    repeated; null ids and urls are kept; other columns are ignored.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            text = [main_text(h) for h in b["html"]]
            yield pd.DataFrame({"page_id": b["page_id"], "url": b["url"], "text": text, "n_chars": [len(t) for t in text]})

    rows = pages.select(F.col(id_col).cast("bigint").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).alias("html"))
    return frames(rows, run, "page_id bigint, url string, text string, n_chars bigint")
