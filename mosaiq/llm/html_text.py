"""Main text of web pages by two passes over their blocks.

A page is cut into blocks. The first pass looks at each block alone: its length, how much
of it is links, how many of its words are stop words, and whether markup names its
surroundings as an article. It decides clear cases and leaves short or doubtful ones open.
In the second pass an open block takes the label of its nearest decided neighbours within
its region.

Markup is a weight, not a verdict. Regions marked as the article win where they hold at
least half of what is good on the page. Elements whose names speak against them are judged
by what the passes find in them: one whose words may as well be the article's subject
(``popular-science``) counts where it holds far more than the rest, one that is plainly a
sidebar or footer only where nothing else is good and it has several good blocks.

Every step takes time in proportion to the page, whatever its markup.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from mosaiq.runtime import ship

#: Rules of the first pass.
SHORT, LONG = 70, 200
MOST_LINKS, LOW_STOP, HIGH_STOP = 0.5, 0.15, 0.30
#: Below this share of any one language's stop words a page is in none of them; there, longer blocks with few links are prose.
FOREIGN_STOP, LOW_LINKS = 0.15, 0.2
#: Within an article, so many blocks in a row that are links almost throughout are a list of links.
LINK_RUN, LINK_ONLY = 3, 0.9
#: How much a name speaks against its element: where the word may have another meaning, where it is plain, and for readers' words.
WEAK, STRONG, READERS = 1, 10, 1_000_000
MOST_DOUBT = 3 * STRONG
#: A weakly doubtful element must hold so many times the good text of the rest, or so many good blocks within an article; a plain one so many with nothing else good.
FAR_MORE, GOOD_WITHIN, GOOD_ALONE = 3, 2, 3

#: Function words of the languages at hand.
LANGUAGES = [
    frozenset(words.split())
    for words in (
        """a about all also an and are as at be been but by can for from had has have he her his i if in into is it its more not of on one or
        our she so than that the their them there they this to was we were what when which who will with would you""",
        """aber als am an auch auf aus bei das dass dem den der des die durch ein eine einem einen einer er es für hat ich im in ist mit nach nicht
        noch nur oder sich sie sind so über um und uns von vor war wie wird zu zum zur""",
        """au aux avec ce ces cette comme dans de des du elle en est et il ils je la le les leur mais ne nous on ou par pas plus pour qu que qui sa
        se ses son sont sur un une vous""",
        """al con como de del el ella en entre era es esta este fue ha la las lo los más me mi muy no nos o para pero por que se si sin sobre su sus
        también un una y ya""",
    )
]
STOP_WORDS = frozenset().union(*LANGUAGES)

_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_BLOCKS = frozenset(
    """address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3
    h4 h5 h6 head header hr html legend li main menu nav ol p pre section summary table tbody td tfoot th thead title tr ul""".split()
)
#: Elements whose contents are no prose, those that plainly stand beside the article, and one that may hold it.
_DROPPED = frozenset("head title select button textarea label iframe object svg canvas audio video map datalist".split())
_BESIDE, _PERHAPS = frozenset("nav footer aside dialog menu".split()), frozenset(["form"])
#: Elements whose contents are not markup.
_RAW = ("script", "style", "noscript", "template", "iframe", "textarea", "xmp", "svg", "math")
#: Words in class, id or role that mark an element as not part of the article.
_MARKS = frozenset(
    """ad ads adbox adsbygoogle adslot adsense adunit advert adverts advertisement advertising advertorial banner sponsor sponsored promo promos promotion
    promoted nav navbar navigation menu menus submenu sidebar sidebars aside rail footer footnav masthead topbar comment comments commentlist
    discussion disqus reply replies respond responses cookie cookies consent gdpr notice notices alert newsletter subscribe subscription
    signup signin share sharing sharebar social related recommended recommendations recirculation breadcrumb breadcrumbs pagination pager
    popup modal overlay lightbox widget widgets toolbar login search skip copyright legal disclaimer complementary contentinfo dialog
    outbrain taboola teaser teasers trending popular paywall""".split()
)
#: Parts of a word that only tell of layout or kind: with them a mark is as plain as alone; some only beside readers' words.
_GENERIC = frozenset(
    """area bar block bottom box btn button buttons card cards col column columns container cta desktop field fixed form global grid group holder icon
    icons inner item items large left link links list main mini mobile module news outer page panel post posts primary right row secondary
    section site slot small stories sticky strip tab tabs title top unit view wrap wrapper zone""".split()
)
_GENERIC_OF_READERS = _GENERIC | frozenset("author body content count meta text thread".split())
#: Words that mark a page's header, unless they stand within the article.
_HEADER = frozenset("header head hero topnav".split())
#: Marks of what readers wrote: an article among them is hardly the page's.
_READERS = frozenset("comment comments commentlist discussion disqus reply replies respond responses".split())
#: Parts of a word that tell of a layout (``has-sidebar``), and first parts that file an article (``tag-popular``).
_LAYOUT, _FILED = frozenset("has with without no not".split()), frozenset("category cat tag tags topic".split())
#: Parts of a word that name a holder, of which the last part says what else it holds (``content-sidebar``).
_HOLDERS = frozenset("layout content template columns column col grid body".split())
_ARTICLE_MARKS = frozenset("articlebody entrycontent postcontent postbody storybody articlecontent articletext".split())
#: Words that mark what holds the article, perhaps with more around it.
_MAIN_MARKS = frozenset("main content maincontent pagecontent sitecontent story post entry".split())

_OPENS = re.compile(r"<(?:(/?)([A-Za-z][A-Za-z0-9:-]*)|(!--|!\[CDATA\[|[!?]))")
_ENDS = {"!--": "-->", "![CDATA[": "]]>", "!": ">", "?": ">"}
_TAG_STOPS = re.compile("[>\"']")
_RAW_ENDS = {name: re.compile(rf"</{name}\s*>", re.I) for name in _RAW}
_ATTR = re.compile(r"([A-Za-z_:@][-\w:.]*)\s*(?:=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+|[0-9]+")
_WORDS = re.compile(r"[^\W\d_]+")
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7a3]")
_HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


@dataclass
class Block:
    text: str
    linked: int
    heading: bool
    region: tuple[int, int]  # how surely it is the article (2: marked as one, 1: as holding it, 0: neither), and which
    outside: bool
    doubt: int = 0  # how much the words around the region speak against it, READERS for those of readers
    within: bool = False  # whether what is doubtful stands within an article
    label: str = ""


@dataclass
class _Open:
    tag: str
    outside: bool
    region: tuple[int, int]
    link: bool
    heading: bool
    doubt: int = 0
    within: bool = False


def _tags(page: str) -> Iterator[tuple[int, int, bool, str, str]]:
    """``(start, end, closing, name, attributes)`` of tags; comments and the like have no name.

    A quoted value may hold ``>``. Where quotes are so broken that a tag does not end, they
    mean nothing from there on; where there is no ``>`` at all, the rest is text.
    """
    at, quotes = 0, True
    while m := _OPENS.search(page, at):
        if m[3]:
            end = page.find(_ENDS[m[3]], m.end())
            at = len(page) if end < 0 else end + len(_ENDS[m[3]])
            yield m.start(), at, False, "", ""
            continue
        end = _tag_end(page, m.end(), quotes)
        if end < 0 and quotes:
            quotes = False
            end = _tag_end(page, m.end(), quotes)
        if end < 0:
            return
        name, at = m[2].lower(), end
        attributes = page[m.end() : end - 1]
        if not m[1] and name in _RAW and not (attributes.rstrip().endswith("/") and name in ("svg", "math")):
            close = _RAW_ENDS[name].search(page, at)
            at = close.end() if close else len(page)
        yield m.start(), at, bool(m[1]), name, attributes


def _tag_end(page: str, at: int, quotes: bool) -> int:
    """The place after the ``>`` that ends a tag, -1 if there is none."""
    if not quotes:
        return page.find(">", at) + 1 or -1
    while s := _TAG_STOPS.search(page, at):
        at = s.end()
        if s[0] == ">":
            return at
        at = page.find(s[0], at) + 1 or at  # a quote that is not closed is a character like any other
    return -1


class _Stack(list):
    """Open elements, and where those of a name and the blocks among them stand."""

    def __init__(self) -> None:
        super().__init__([_Open("", False, (0, 0), False, False)])
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []
        self.firm: list[int] = []  # blocks other than paragraphs

    def push(self, one: _Open) -> None:
        self.places.setdefault(one.tag, []).append(len(self))
        if one.tag in _BLOCKS:
            self.blocks.append(len(self))
            if one.tag != "p":
                self.firm.append(len(self))
        self.append(one)

    def cut(self, depth: int) -> None:
        while len(self) > depth:
            self.places[self.pop().tag].pop()
            for kind in (self.blocks, self.firm):
                if kind and kind[-1] == len(self):
                    kind.pop()

    def close(self, name: str) -> bool:
        """Close the innermost element of the name; inline ones do not reach beyond a block."""
        depth = (self.places.get(name) or [0])[-1]
        if not depth or (name not in _BLOCKS and self.firm and self.firm[-1] > depth):
            return False
        self.cut(depth)
        return True

    def imply_ends(self, name: str) -> None:
        """A block ends an open paragraph, and an item or cell the one before it."""
        if self.blocks:
            tag = self[self.blocks[-1]].tag
            if tag == "p" or (tag == name and name in ("li", "dt", "dd", "tr", "td", "th")):
                self.cut(self.blocks[-1])


def blocks_of(page: str) -> list[Block]:
    """The page's blocks in order, without scripts, styles and comments; references are decoded."""
    found: list[Block] = []
    stack = _Stack()
    pieces: list[tuple[str, bool]] = []
    state = [False, (0, 0), False, 0, False]  # of the block begun: outside, region, heading, doubt, within
    filled = False
    regions = at = 0

    def end_block() -> None:
        nonlocal filled
        text = " ".join("".join(p for p, _ in pieces).split())
        if text:
            linked = len(" ".join("".join(p for p, link in pieces if link).split()))
            found.append(Block(text, linked, state[2], state[1], state[0], state[3], state[4]))
        pieces.clear()
        filled = False

    def add(raw: str) -> None:
        nonlocal filled
        if raw:
            top = stack[-1]
            if filled and [top.outside, top.region, top.doubt] != [*state[:2], state[3]]:
                end_block()
            if not filled:
                state[:] = [top.outside, top.region, top.heading, top.doubt, top.within]
            text = html.unescape(raw) if "&" in raw else raw
            filled = filled or not text.isspace()
            pieces.append((text, top.link))

    for start, end, closing, name, attributes in _tags(page):
        add(page[at:start])
        at = end
        if not name or (not closing and name in _RAW):
            continue
        if closing:
            if name in _BLOCKS:
                end_block()
            if not stack.close(name) and name == "p":
                end_block()
            continue
        if name == "br":
            add(" ")
            continue
        if name in _BLOCKS:
            end_block()
            stack.imply_ends(name)
        if name in _VOID or attributes.endswith("/"):
            continue
        top = stack[-1]
        outside, sure, doubt = _marks(name, attributes, top.region[0] == 2)
        region, within = top.region, top.within
        if doubt or sure > region[0]:
            regions += 1
            region, within = (sure, regions), within or (doubt > 0 and region[0] == 2)
        stack.push(_Open(name, outside or top.outside, region, name == "a" or top.link, bool(re.fullmatch("h[1-6]", name)) or top.heading, _added(top.doubt, doubt), within))
    add(page[at:])
    end_block()
    return found


def _added(doubt: int, more: int) -> int:
    """Doubts of nested elements together: weak ones never make a strong one, readers' words outweigh all."""
    if READERS in (doubt, more):
        return READERS
    return min(doubt + more, STRONG - 1 if max(doubt, more) < STRONG else MOST_DOUBT)


def _marked(word: str, in_article: bool) -> int:
    """How much a word of class, id or role speaks against its element: 0, ``WEAK``, ``STRONG`` or ``READERS``.

    The whole word counts, or its first or last part; others tell what an element holds or
    is next to. Where parts besides the mark have a meaning of their own, as in
    ``popular-science``, it is a weak one.
    """
    parts = [p.lower() for p in _PARTS.findall(word) if len(p) > 1]
    if not parts or _LAYOUT & set(parts) or parts[0] in _FILED:
        return 0
    told = {parts[0], word.lower(), re.sub(r"[^a-z]", "", word.lower())} | ({parts[-1]} if not _HOLDERS & set(parts) else set())
    marks = _MARKS if in_article else _MARKS | _HEADER
    names = [p for p in parts if not p.isdigit()]
    plain = len(told & (marks | _READERS)) > 1 or bool(told & (marks | _READERS) - set(names))
    if told & _READERS:
        return READERS if plain or set(names) <= marks | _READERS | _GENERIC_OF_READERS else WEAK
    if told & marks:
        return STRONG if plain or set(names) <= marks | _GENERIC else WEAK
    return 0


def _comment(value: str) -> bool:
    """Whether an article's words say that it is itself a comment, and not that it has some (``comments-open``)."""
    return any(w.lower() in _READERS or re.split("[^a-z]", w.lower())[0] in ("comment", "reply", "response") for w in value.split())


def _marks(name: str, attributes: str, in_article: bool) -> tuple[bool, int, int]:
    """Whether an element stands outside the article for sure, how surely it is one, and how much its words speak against it."""
    outside, sure = name in _DROPPED, {"article": 2, "main": 1}.get(name, 0)
    doubt = STRONG if name in _BESIDE or (name == "header" and not in_article) else WEAK if name in _PERHAPS else 0
    named = sure > 0
    for a in _ATTR.finditer(attributes):
        key, value = a[1].lower(), a[2] or a[3] or a[4] or ""
        if key == "hidden" or (key == "aria-hidden" and value == "true") or (key == "style" and _HIDDEN.search(value)):
            outside = True
        elif key == "itemprop" and value.lower() == "articlebody" or key == "role" and value.lower() in ("main", "article"):
            sure, named = max(sure, 1 if value.lower() == "main" else 2), True
        elif key in ("class", "id", "role", "data-role") and name not in ("html", "body"):
            for word in value.split():
                plain = re.sub(r"[^a-z]", "", word.lower())
                doubt = max(doubt, _marked(word, in_article))
                sure = max(sure, 2 * (plain in _ARTICLE_MARKS), plain in _MAIN_MARKS)
    if (named or sure == 2) and (doubt < READERS or not any(_comment(a[2] or a[3] or a[4] or "") for a in _ATTR.finditer(attributes) if a[1].lower() in ("class", "id"))):
        doubt = 0
    return outside, sure, doubt


def classify(found: list[Block]) -> None:
    """Label blocks ``good`` or ``bad``, and ``outside`` where the article is elsewhere.

    Doubtful elements are weighed from the least doubtful on. One that is marked as an
    article, as in ``<div class="sidebar-right"><article>``, counts where it is longer than
    all that is good without it. Others count by the blocks in them that are good alone:
    weak ones where these are ``FAR_MORE`` times as long as what is good, or at least
    ``GOOD_WITHIN`` blocks within an article; strong ones where nothing is good and there
    are at least ``GOOD_ALONE``. What readers wrote counts only where it is marked as an
    article and nothing is good.
    """
    _decide(found, set())
    groups: dict[tuple[int, tuple[int, int]], list[Block]] = {}
    for b in found:
        if b.doubt and not b.outside:
            groups.setdefault((b.doubt, b.region), []).append(b)
    sizes = {key: _good_alone(blocks) for key, blocks in groups.items()}
    taken: set[tuple[int, int]] = set()
    for doubt in sorted({d for d, _ in groups}):
        good = sum(len(b.text) for b in found if b.label == "good")
        more = {region for (d, region), blocks in groups.items() if d == doubt and _outweighs(doubt, region, blocks, *sizes[d, region], good)}
        if more:
            taken |= more
            _decide(found, taken)


def _good_alone(blocks: list[Block]) -> tuple[int, int]:
    """How many blocks are good by themselves, whatever marks them, and their length."""
    foreign = _foreign(blocks)
    good = [b for b in blocks if _alone(b, foreign, False) == "good"]
    return len(good), sum(len(b.text) for b in good)


def _outweighs(doubt: int, region: tuple[int, int], blocks: list[Block], n: int, length: int, good: int) -> bool:
    """Whether a doubtful region counts, beside ``good`` characters of the rest."""
    if region[0]:
        return sum(len(b.text) for b in blocks) > good and (doubt < READERS or not good)
    if doubt < STRONG:
        return n >= GOOD_WITHIN if blocks[0].within else length > FAR_MORE * good
    return doubt < READERS and not good and n >= GOOD_ALONE


def _decide(found: list[Block], taken: set[tuple[int, int]]) -> None:
    """Label blocks in two passes and choose the article's regions; of the doubtful regions those of ``taken`` count.

    Regions of the surest mark win that, with those of surer ones, hold at least half of
    what is good. Surer regions that lose by holding less than a quarter are cards of other
    stories.
    """
    inside = [b for b in found if not b.outside and (not b.doubt or b.region in taken)]
    for b in found:
        b.label = "outside"
    foreign = _foreign([b for b in inside if not b.region[0]])
    for b in inside:
        b.label = _alone(b, foreign, b.region[0] > 0)
    _settle_links(inside)
    # Longer doubtful blocks first, so that short ones between them can follow.
    for kind in ("near", "short"):
        _inherit(inside, kind)
    sizes = [sum(len(b.text) for b in inside if b.label == "good" and b.region[0] >= sure) for sure in (0, 1, 2)]
    sure = max((i for i in (0, 1, 2) if 2 * sizes[i] >= sizes[0]), default=0)
    cards = sure < 2 and 4 * sizes[sure + 1] < sizes[0]
    for b in inside:
        if (b.region[0] < sure and not b.within) or (b.region[0] > sure and cards):
            b.label = "outside"


def _alone(b: Block, foreign: bool, marked: bool) -> str:
    """First pass: ``good``, ``bad``, or open as ``link``, ``near`` or ``short``, from the block itself.

    In a marked region length and few links are enough; elsewhere stop words must speak for it.
    """
    n = _weight(b.text)
    if b.linked > MOST_LINKS * len(b.text):
        return "short" if b.heading else "link" if marked else "bad"
    if n < SHORT:
        return "short"
    if marked or (foreign and b.linked <= LOW_LINKS * len(b.text)):
        return "good"
    words = _WORDS.findall(b.text.lower())
    stop = sum(w in STOP_WORDS for w in words) / max(1, len(words))
    return "good" if stop >= HIGH_STOP and n >= LONG else "near" if stop >= LOW_STOP else "bad"


def _settle_links(inside: list[Block]) -> None:
    """In marked regions links speak against blocks where they follow each other as a list; else these are open like short ones."""
    run: list[Block] = []
    for b in [*inside, None]:
        if b and b.label == "link" and (not run or run[-1].region == b.region):
            run.append(b)
            continue
        listed = len(run) >= LINK_RUN and all(x.linked >= LINK_ONLY * len(x.text) for x in run)
        for x in run:
            x.label = "bad" if listed else "short"
        run = [b] if b and b.label == "link" else []


def _inherit(inside: list[Block], kind: str) -> None:
    """Second pass: open blocks of a kind take the label of their nearest decided neighbours within their region.

    In a marked region a block is bad only between two bad ones. Elsewhere only bad blocks
    speak against a longer block, a heading needs a good block after it, and a short block
    a good neighbour and no bad one.
    """
    sides: list[list[str | None]] = []
    for order in (inside, inside[::-1]):
        last: dict[tuple[int, int], str] = {}
        side = []
        for b in order:
            side.append(last.get(b.region))
            if b.label in ("good", "bad"):
                last[b.region] = b.label
        sides.append(side)
    for b, before, after in zip(inside, sides[0], reversed(sides[1])):
        if b.label != kind:
            continue
        if b.region[0]:
            b.label = "bad" if before == after == "bad" else "good"
        elif kind == "near":
            b.label = "bad" if {before, after} - {None} == {"bad"} else "good"
        elif b.heading:
            b.label = after or "bad"
        else:
            b.label = "good" if {before, after} - {None} == {"good"} else "bad"


def _foreign(found: list[Block]) -> bool:
    """Whether the page's stop words are of no listed language."""
    words = [w for b in found if b.linked <= LOW_LINKS * len(b.text) for w in _WORDS.findall(b.text.lower())]
    return max(sum(w in listed for w in words) for listed in LANGUAGES) < FOREIGN_STOP * len(words)


def _weight(text: str) -> int:
    """Length, in which a character of a script that writes words with one or two counts for three."""
    return len(text) + 2 * len(_DENSE.findall(text))


def main_text(page: str | None) -> str:
    found = blocks_of(page or "")
    classify(found)
    return "\n".join(b.text for b in found if b.label == "good")


def extract(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with ``out``: the article's blocks, one a line; empty where there is none.

    Null and empty pages give the empty string. Pages of any length and markup take time in
    proportion to their length. A column named ``out`` is replaced. Pages are independent of
    each other, so ties, repeated rows and an empty table need no care.
    """
    ship(pages.sparkSession)

    @F.pandas_udf("string")
    def text(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in batches:
            yield pd.Series([main_text(p) for p in pages], dtype=object)

    return pages.withColumn(out, text(F.col(html_col)))
