"""Main text of HTML pages by two-pass block rules.

A tolerant scanner cuts a page into blocks of text at block-level tags, in time in
proportion to the page, with the share of text inside links and the region that each
block lies in: an article, an element that names itself a part of the frame (menu,
footer, sidebar, form, advert, notice, comments), or the rest of the page. Elements and
names are features; densities and neighbours decide:

* First pass, by density. Much link text is boilerplate. Text with many stop words, or
  long text with some, is content; but not in a frame element, since the prose of
  notices, adverts and reader comments has the densities of an article's, so that only
  its element tells it. Long text with few stop words is boilerplate, unless it is in an article
  or its region as a whole has enough of them. Whatever else is short stays open.
* Second pass, by neighbours. Open blocks take the label of the nearest decided blocks
  of their region: that of both if they agree; else headings take the next one's, blocks
  of an article that of the content, others the nearer one's. Blocks of a frame element
  are no neighbours of blocks outside it, since the element says where they end.
* A region in which no block was decided is judged as one text by the same densities.
  If that too says nothing, a frame element is boilerplate, an article is content, and
  the rest of a page is content if there is nothing else.

Text is decoded, white space inside a block becomes one space, and the content
blocks are joined in page order by an empty line. Nothing is dropped from a block
that is kept, and there is no limit on lengths.

Defined results: null or empty html gives an empty text; a page without markup is
one block; elements that are never closed end with what encloses them; a tag that is
never closed, and a quoted value in it, goes on to the end; rows are
judged apart, so repeated rows give repeated results; other columns, whatever their
names, take no part; an empty table gives an empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from peneira.llm.common import utf8

# The roles of HTML elements.
BLOCK_TAGS = frozenset("address article aside blockquote body button caption center dd details dialog div dl dt fieldset figcaption figure footer form frameset h1 h2 h3 h4 h5 h6 header hgroup hr html iframe legend li main menu nav noscript ol option p pre section select summary table tbody td tfoot th thead title tr ul".split())
HIDDEN_TAGS = frozenset("head title script style noscript template svg math canvas object applet iframe audio video map textarea select option datalist noframes".split())
RAW_TAGS = frozenset("script style textarea title xmp iframe noembed noframes".split())
VOID_TAGS = frozenset("area base br col embed hr img input link meta param source track wbr".split())
OUTER_TAGS = frozenset("nav footer aside form menu button dialog fieldset".split())
ARTICLE_TAGS = frozenset("article main".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
ENDS_P = BLOCK_TAGS - frozenset("button caption dd dt iframe legend noscript option select tbody td tfoot th thead title tr html body li summary".split())
OUTER_NAMES = frozenset("ad ads adv advert adverts advertisement advertising adbox adsbox banner sponsor sponsored promo promotion nav navbar navigation menu menubar breadcrumb breadcrumbs pager pagination toolbar header masthead topbar footer foot bottombar copyright sidebar side aside widget related recommended recommendations share sharing social cookie cookies consent gdpr notice alert popup modal overlay newsletter subscribe subscription signup login search comment comments comment-list commentlist respond reply replies disqus discussion reactions feedback form skip hidden legal disclaimer".split())
COMMENT_NAMES = frozenset("comment comments comment-list commentlist reply replies".split())
OUTER_ROLES = frozenset("navigation banner contentinfo complementary search form menu menubar alert dialog alertdialog".split())
# Common words of English, French, German and Spanish.
STOP_WORDS = frozenset("the of and to in is it that was for on with as by be this are at from or an he she they we you not have has his her their its but which were been will would can there a i".split()) | frozenset("le la les de des du un une et en est que qui dans pour par sur au aux avec ce cette se sa son ses il elle ne pas plus ou mais nous vous on d l".split()) | frozenset("der die das den dem des ein eine einer und in zu von mit ist im auf für nicht sich als auch an es bei nach aus wie dass er sie wir sind war zum zur".split()) | frozenset("el la los las de del un una y en que es se por con para su al lo como más pero sus este esta no o fue son ha".split())

SHORT, LONG = 60, 160
STOP_LOW, STOP_HIGH = 0.12, 0.25
LINKS = 0.33

_NAME_OF_TAG = re.compile(r"(/?)([a-zA-Z][^\s/>]*)")
_TAG_STOP = re.compile(r">|=\s*([\"'])")
_LONG_REFERENCE = re.compile(r"&#(?:0*[0-9]{8,}|[xX]0*[0-9a-fA-F]{8,});?")
_PADDED_REFERENCE = re.compile(r"&#([xX]?)0+(?=[0-9a-fA-F])")
_ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_SPACE = re.compile(r"\s+")
_NAME = re.compile(r"[A-Za-z]+(?:-[a-z]+)?|[A-Za-z]+")
_WORD = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    links: int
    outer: bool
    article: bool
    heading: bool
    region: int
    #: In a frame by names alone, not by an element's own kind.
    named: bool = False


def decoded(text: str) -> str:
    """Character references decoded; those of no character, however long, are U+FFFD."""
    if "&" not in text:
        return text
    if "&#" in text:
        text = _LONG_REFERENCE.sub("\ufffd", _PADDED_REFERENCE.sub(r"&#\1", text))
    return html.unescape(text)


def _names_outer(attributes: str, only: frozenset[str] | None = None) -> bool:
    """Whether class, id or role say that an element holds no main text; with ``only``, by these names."""
    if not attributes or not attributes.strip(" /"):
        return False
    for name, a, b, c in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), a or b or c
        if name in ("class", "id"):
            for word in value.split():
                if only is not None:
                    if word.lower() in only:
                        return True
                    continue
                if word.lower() in OUTER_NAMES:
                    return True
                parts = {x.lower() for x in _PARTS.findall(word)}
                # "main-header" is one, "article-with-sidebar" is not
                if parts & OUTER_NAMES and not parts & {"main", "article", "content", "post", "entry", "body", "has", "with", "no", "text", "title", "story"}:
                    return True
                if parts & {"comment", "comments", "sidebar", "cookie", "advert", "footer", "navbar", "nav", "menu"} and not parts & {"has", "with", "no"}:
                    return True
        elif name == "role" and value.lower() in OUTER_ROLES and only is None or name == "hidden" or name == "aria-hidden" and value.lower() == "true":
            return True
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return True
    return False


def _tag_end(page: str, at: int, closes: dict[str, int]) -> int:
    """Where the ``>`` of a tag is, or the end of the page; quoted values are passed over."""
    while True:
        m = _TAG_STOP.search(page, at)
        if not m:
            return len(page)
        if not m[1]:
            return m.start()
        at = m.end()
        if closes[m[1]] >= at:
            at = page.find(m[1], at) + 1


class _Stack:
    """Open elements, with what is asked of them at hand, so that no question walks the stack."""

    def __init__(self):
        self.items: list[tuple[str, bool, bool]] = []  # tag, outer, by its kind
        self.places: dict[str, list[int]] = {}
        self.block_places: list[int] = []
        self.hidden_places: list[int] = []
        self.outer = self.kinds = self.link = self.article = self.heading = 0
        self.regions, self.made = [0], 0

    def push(self, tag: str, outer: bool, kind: bool, hidden: bool) -> None:
        at = len(self.items)
        self.items.append((tag, outer, kind))
        self.places.setdefault(tag, []).append(at)
        if tag in BLOCK_TAGS:
            self.block_places.append(at)
        if hidden:
            self.hidden_places.append(at)
        if outer or tag in ARTICLE_TAGS:
            self.made += 1
            # what lies in a frame element belongs to it
            self.regions.append(self.regions[-1] if self.outer else self.made)
        self.outer += outer
        self.kinds += kind
        self.link += tag == "a"
        self.article += tag in ARTICLE_TAGS
        self.heading += tag in HEADINGS

    def pop(self) -> str:
        tag, outer, kind = self.items.pop()
        at = len(self.items)
        self.places[tag].pop()
        if tag in BLOCK_TAGS:
            self.block_places.pop()
        if self.hidden_places and self.hidden_places[-1] == at:
            self.hidden_places.pop()
        if outer or tag in ARTICLE_TAGS:
            self.regions.pop()
        self.outer -= outer
        self.kinds -= kind
        self.link -= tag == "a"
        self.article -= tag in ARTICLE_TAGS
        self.heading -= tag in HEADINGS
        return tag


def _ends(open_: str, tag: str) -> bool:
    """Whether an open element ends where another starts."""
    if open_ == "p":
        return tag in ENDS_P or tag in ("li", "dd", "dt", "td", "tr")
    if open_ in ("dd", "dt"):
        return tag in ("dd", "dt")
    return open_ == tag and tag in ("li", "option", "td", "th", "tr") or open_ in HEADINGS and tag in HEADINGS


def blocks(page: str) -> list[Block]:
    """The blocks of a page in order, those without text left out."""
    out: list[Block] = []
    stack, text, links = _Stack(), [], 0

    def cut() -> None:
        nonlocal links
        whole = _SPACE.sub(" ", decoded("".join(text))).strip() if text else ""
        if whole:
            out.append(Block(whole, min(links, len(whole)), stack.outer > 0, stack.article > 0, stack.heading > 0, stack.regions[-1], not stack.kinds))
        text.clear()
        links = 0

    def leave(depth: int) -> None:
        while len(stack.items) > depth:
            if stack.items[-1][0] in BLOCK_TAGS:
                cut()
            stack.pop()

    def said(piece: str) -> None:
        nonlocal links
        if piece and not stack.hidden_places:
            text.append(piece)
            if stack.link:
                links += len(decoded(piece).strip())

    at, n = 0, len(page)
    closes = {q: page.rfind(q) for q in "\"'"}
    while at < n:
        begin = page.find("<", at)
        if begin < 0:
            said(page[at:])
            break
        said(page[at:begin])
        if page.startswith(("<!--", "<![CDATA["), begin):
            mark = "-->" if page.startswith("<!--", begin) else "]]>"
            end = page.find(mark, begin + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), begin):
            end = page.find(">", begin)
            at = end + 1 if end >= 0 else n
            continue
        m = _NAME_OF_TAG.match(page, begin + 1)
        if not m:
            said("<")
            at = begin + 1
            continue
        end = _tag_end(page, m.end(), closes)
        closing, tag, attributes, at = m[1], m[2].lower(), page[m.end() : end], end + 1
        if closing:
            if tag == "br":
                text.append(" ")
            # what was opened inside and not closed ends too, but a cell or item ends no table around it
            places = stack.places.get(tag)
            if not places:
                if tag in BLOCK_TAGS:
                    cut()
            elif tag in BLOCK_TAGS or not stack.block_places or stack.block_places[-1] < places[-1]:
                leave(places[-1])
            continue
        if tag in VOID_TAGS:
            if tag == "hr":
                cut()
            elif tag in ("br", "img", "input"):
                text.append(" ")
            continue
        if tag in BLOCK_TAGS:
            cut()
            if stack.block_places and _ends(stack.items[stack.block_places[-1]][0], tag):
                leave(stack.block_places[-1])
        closed = attributes == "/" or attributes.endswith(('"/', "'/", " /"))
        if closed and tag not in BLOCK_TAGS and tag not in HIDDEN_TAGS:
            continue
        kind = tag in OUTER_TAGS or tag == "header" and not stack.article
        # an article or main element is no frame whatever it is called, but for reader comments
        outer = kind or tag not in ("html", "body") and _names_outer(attributes, COMMENT_NAMES if tag in ARTICLE_TAGS else None)
        stack.push(tag, outer, kind, tag in HIDDEN_TAGS)
        if tag in RAW_TAGS:
            close = re.compile(rf"</{re.escape(tag)}(?=[\s/>])", re.I).search(page, at)
            end = page.find(">", close.end()) if close else -1
            at = end + 1 if end >= 0 else n
            leave(len(stack.items) - 1)
        elif tag == "body":
            # what the head left open ends here
            stack.hidden_places.clear()
    cut()
    return out


GOOD, BAD, OPEN = 1, 0, -1


@dataclass
class Density:
    """Sizes of a block, or of several together."""

    chars: int = 0
    links: int = 0
    words: int = 0
    stops: int = 0

    @classmethod
    def of(cls, block: Block) -> Density:
        words = _WORD.findall(block.text.lower())
        return cls(len(block.text), block.links, len(words), sum(w in STOP_WORDS for w in words))

    def add(self, other: Density) -> None:
        self.chars, self.links, self.words, self.stops = self.chars + other.chars, self.links + other.links, self.words + other.words, self.stops + other.stops

    def judged(self) -> tuple[int, str]:
        """Content, boilerplate or open, and why."""
        share = self.stops / (self.words or 1)
        if self.links > LINKS * self.chars:
            return BAD, "links"
        if self.chars >= SHORT and share >= STOP_HIGH or self.chars >= LONG and share >= STOP_LOW:
            return GOOD, "stop words"
        if self.chars >= LONG and share < STOP_LOW / 2:
            return BAD, "few stop words"
        return OPEN, "open"


def decide(found: list[Block]) -> list[tuple[int, str]]:
    """Content or boilerplate for each block, and the rule that says so."""
    sizes, regions = [Density.of(b) for b in found], {}
    for b, size in zip(found, sizes, strict=True):
        regions.setdefault(b.region, Density()).add(size)
    found = _unframed(found, sizes)
    first: list[tuple[int, str]] = []
    for b, size in zip(found, sizes, strict=True):
        label, why = size.judged()
        if label == GOOD and b.outer:
            label, why = BAD, "frame element"
        elif why == "few stop words" and (b.article or regions[b.region].stops >= STOP_LOW / 2 * regions[b.region].words):
            label, why = OPEN, "open"
        first.append((label, why))
    out = list(first)
    decided = {b.region for b, (label, _) in zip(found, first, strict=True) if label != OPEN}
    before, after = _neighbours(found, first), _neighbours(found[::-1], first[::-1])[::-1]
    # nothing else on the page can be its text
    alone = not any(label == GOOD for label, _ in first) and not any(b.article for b in found)
    for i, b in enumerate(found):
        if first[i][0] != OPEN:
            continue
        if b.region not in decided:
            label, why = regions[b.region].judged()
            if b.outer:
                out[i] = (BAD, "frame element")
            elif label != OPEN and not (label == BAD and b.article):
                out[i] = (label, "region")
            else:
                out[i] = (GOOD, "article") if b.article else (GOOD if alone else BAD, "page")
            continue
        left, right = before[i], after[i]
        if left is None or right is None:
            j = left if right is None else len(found) - 1 - right
            label = first[j][0]
        else:
            p, q = left, len(found) - 1 - right
            label = first[p][0]
            if first[q][0] != label:
                label = first[q][0] if b.heading else GOOD if b.article else label if i - p <= q - i else first[q][0]
        out[i] = (label, "neighbour")
    return out


def _unframed(found: list[Block], sizes: list[Density]) -> list[Block]:
    """Where all dense text stands in frames, the region with most of it that is one by its names alone is none: densities come first."""
    dense: dict[int, int] = {}
    for b, size in zip(found, sizes, strict=True):
        if size.judged()[0] == GOOD:
            if not b.outer:
                return found
            if b.named:
                dense[b.region] = dense.get(b.region, 0) + size.chars
    if not dense:
        return found
    main = max(dense, key=lambda r: (dense[r], -r))
    return [replace(b, outer=False) if b.region == main else b for b in found]


def _neighbours(found: list[Block], first: list[tuple[int, str]]) -> list[int | None]:
    """For each block the nearest decided one of its region before it."""
    last, out = {}, []
    for i, b in enumerate(found):
        out.append(last.get(b.region))
        if first[i][0] != OPEN:
            last[b.region] = i
    return out


def labels(found: list[Block]) -> list[int]:
    """Content or boilerplate for each block: both passes."""
    return [label for label, _ in decide(found)]


def main_text(page: str | None) -> str:
    found = blocks(page or "")
    return "\n\n".join(b.text for b, label in zip(found, labels(found), strict=True) if label == GOOD)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        pages = utf8(batch.column(2))
        texts = [main_text(pages[row].as_py()) for row in range(batch.num_rows)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"])


def extract(pages: DataFrame) -> DataFrame:
    """Per row: page_id, url, text and n_chars (code points)."""
    some = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.col("html").cast("string").alias("html"))
    return some.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
