"""Main text of web pages by two passes of block rules.

Pass one labels each block by link density, length and stop-word density. Pass two
gives ambiguous blocks the label of the nearest decided neighbours. Elements that name
their role (nav, footer, adverts, comments and the like) are left out beforehand; an
article element is evidence for its blocks, so that what is undecided there stays
unless its neighbours speak against it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from driftline.llm.common import arrow_columns, strings, struct

#: A tag with quotes in pairs, one without regard to quotes, and declarations.
QUOTED = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)((?:\"[^\"]*+\"|'[^']*+'|[^\"'>]++)*+)>")
LOOSE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*+)([^>]*+)>")
OTHER = re.compile(r"<[!?/][^>]*+>")
#: Tags of a page without paired quotes after which quotes are no longer heeded.
MOST_LOOSE = 16
#: Elements whose content is not text, each with its end.
RAW = {
    t: re.compile(rf"</{t}\s*>", re.I)
    for t in "script style noscript template textarea svg math iframe title object canvas audio video".split()
}
ATTRIBUTE = re.compile(r"(?<![\w:.-])([a-zA-Z_:][\w:.-]*+)\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s\"'>]++))")
#: Numbers beyond all characters, which would be too long to convert.
FAR_NUMBER = re.compile(r"&#(?:0*+[1-9][0-9]{8,}+|[xX]0*+[1-9a-fA-F][0-9a-fA-F]{8,}+);?")
ZEROS = re.compile(r"&#([xX]?)0{8,}+")
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
BLOCKS = frozenset(
    "address article aside blockquote body caption center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 head header hgroup hr html legend li main menu nav ol optgroup option p pre search section select summary "
    "table tbody td tfoot th thead tr ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements whose text is never part of an article.
OUT = frozenset("aside button datalist dialog footer form head header menu nav search select".split())
OUT_ROLES = frozenset("alert alertdialog banner complementary contentinfo dialog form menu menubar navigation search toolbar".split())
#: Words in class or id that tell such elements.
OUT_WORDS = frozenset(
    "ad ads adv advert advertisement adverts advertising banner breadcrumb breadcrumbs comment comments commentlist consent cookie cookies "
    "disqus footer gdpr masthead menu modal nav navbar navigation newsletter notice notification popup promo promoted promotion related "
    "replies reply respond share sharing sidebar signup skip social sponsor sponsored subscribe subscription toolbar widget".split()
)
NOT_ALONE = frozenset("has with no without".split())
PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
#: Frequent function words, by language.
STOP_WORDS_BY_LANGUAGE = {
    "en": "a about all an and are as at be been but by can for from had has have he his i if in is it its not of on or she so that the their they this to was we were what when which who will with you",
    "de": "als am an auch auf aus bei das dem den der des die du ein eine einen einer er es für hat ich im in ist mit nach nicht oder sein sich sie sind so um und uns von vor war was wenn wie wir zu zum zur",
    "fr": "au aux avec ce ces cette dans de des du elle en est et eux il je la le les leur lui mais ne nous on ou où par pas pour qu que qui sa se ses son sont sur tu un une vous y",
    "es": "al como con de del desde el ella en entre era es esta este ha la las lo los más me mi no nos o para pero por porque que se si sin sobre son su sus un una y ya yo",
}
STOP_WORDS = frozenset(w for words in STOP_WORDS_BY_LANGUAGE.values() for w in words.split())
#: Limits: characters of short and long blocks, share of linked characters, shares of stop words.
SHORT, LONG, LINKS, FEW, MANY = 70, 200, 0.5, 0.08, 0.18
#: A page whose longer blocks have a smaller share of known stop words is in another language.
KNOWN = 0.07


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    article: int  # number of the article element around it, 0 for none
    heading: bool


def _names_boilerplate(attributes: str, tag: str) -> bool:
    named = {m[1].lower(): m[2] or m[3] or m[4] or "" for m in ATTRIBUTE.finditer(attributes)}
    if named.get("role", "").lower() in OUT_ROLES or "hidden" in attributes.lower().split() or named.get("aria-hidden") == "true":
        return True
    for name in f"{named.get('class', '')} {named.get('id', '')}".split():
        parts = {p.lower() for p in PART.findall(name)}
        if parts & OUT_WORDS and not parts & NOT_ALONE:
            return True
    return False


def tokens_of(page: str) -> Iterator[tuple[str, str, str, str]]:
    """(text, tag, "/" if it closes, attributes): each piece of text with the tag after it, which may be none.

    Comments, declarations and the content of RAW elements are left out. Linear in the
    page: where no ">" follows, "<" is text; a few tags whose quotes don't pair up are
    read to the next ">", and so is any tag after those.
    """
    at = start = loose = 0
    last = page.rfind(">")
    while (i := page.find("<", at)) >= 0:
        if page.startswith("<!--", i):
            j = page.find("-->", i + 4)
            yield page[start:i], "", "", ""
            at = start = len(page) if j < 0 else j + 3
        elif page.startswith("<![CDATA[", i):
            j = page.find("]]>", i + 9)
            yield page[start:i] + page[i + 9 : len(page) if j < 0 else j], "", "", ""
            at = start = len(page) if j < 0 else j + 3
        elif i > last:
            at = i + 1
        else:
            m = QUOTED.match(page, i) if loose < MOST_LOOSE else None
            if m is None and (m := LOOSE.match(page, i)):
                loose += 1
            if m:
                tag, end = m[2].lower(), m.end()
                if tag in RAW:
                    if not m[1]:
                        close = RAW[tag].search(page, end)
                        end = close.end() if close else len(page)
                    tag = ""
                yield page[start:i], tag, m[1], m[3]
                at = start = end
            elif m := OTHER.match(page, i):
                yield page[start:i], "", "", ""
                at = start = m.end()
            else:
                at = i + 1
    yield page[start:], "", "", ""


def _decoded(text: str) -> str:
    if "&" not in text:
        return text
    return html.unescape(ZEROS.sub(r"&#\g<1>0", FAR_NUMBER.sub("\ufffd", text)) if "&#" in text else text)


class _Open:
    """An open element. hard: it is left out for good, whatever opens inside."""

    __slots__ = ("tag", "out", "article", "hard")

    def __init__(self, tag: str, out: bool, article: int, hard: bool):
        self.tag, self.out, self.article, self.hard = tag, out, article, hard


class _Stack(list[_Open]):
    """Open elements, with places by tag, so that closing one takes no search."""

    def __init__(self):
        super().__init__()
        self.places: dict[str, list[int]] = {}
        self.bounds: list[int] = []  # of article, main and body
        self.hard = self.first_out = 0

    def push(self, e: _Open) -> None:
        self.places.setdefault(e.tag, []).append(len(self))
        if e.tag in BOUNDS:
            self.bounds.append(len(self))
        self.hard += e.hard
        self.append(e)

    def cut(self, n: int) -> None:
        while len(self) > n:
            e = self.pop()
            self.places[e.tag].pop()
            if e.tag in BOUNDS:
                self.bounds.pop()
            self.hard -= e.hard
        self.first_out = min(self.first_out, n)

    def close(self, tag: str) -> None:
        if at := self.places.get(tag):
            if tag in BOUNDS or tag == "html" or not self.bounds or at[-1] > self.bounds[-1]:
                self.cut(at[-1])

    def let_in(self) -> None:
        """Nothing that is open is left out any more."""
        for e in self[self.first_out :]:
            e.out = False
        self.first_out = len(self)


BOUNDS = frozenset(("article", "main", "body"))


def blocks_of(page: str) -> list[Block]:
    """Blocks with text, in page order, without those of elements that are left out."""
    out: list[Block] = []
    stack = _Stack()
    text: list[str] = []
    linked = links = articles = 0
    heading = False

    def state() -> tuple[bool, int]:
        return (stack[-1].out, stack[-1].article) if stack else (False, 0)

    def flush() -> None:
        nonlocal linked, heading
        if text:
            body = " ".join(_decoded("".join(text)).split())
            if body:
                out.append(Block(body, linked, state()[1], heading))
            text.clear()
        linked, heading = 0, False

    def add(piece: str) -> None:
        nonlocal linked
        if piece and not state()[0]:
            text.append(piece)
            if links:
                linked += len(" ".join(piece.split()))

    for piece, tag, closing, attributes in tokens_of(page):
        add(piece)
        if not tag:
            continue
        if tag == "br":
            add(" ")
        elif tag == "a":
            links = 0 if closing else 1
        elif closing:
            if tag in BLOCKS:
                flush()
            stack.close(tag)
        else:
            block = tag in BLOCKS
            if block:
                flush()
                if stack and stack[-1].tag in ("p", *HEADINGS):  # an open paragraph ends here
                    stack.cut(len(stack) - 1)
            gone, article = state()
            if tag in VOID:
                continue
            soft = False
            if tag in ("article", "main"):
                nested = bool(stack.places.get("article"))
                if not nested and gone and not stack.hard:  # a menu or wrapper that was never closed
                    gone = False
                    stack.let_in()
                if nested and not gone:
                    gone = _names_boilerplate(attributes, tag)
                if not article:
                    articles += 1
                    article = articles
            elif not gone and tag not in ("html", "body"):
                if tag in OUT and not (tag == "header" and article):
                    gone = True
                elif (block or tag in ("span", "ins", "figure")) and _names_boilerplate(attributes, tag):
                    gone = soft = True
            if block or gone:
                stack.push(_Open(tag, gone, article, gone and not soft and tag not in ("nav", "header", "footer", "form", "head")))
            heading = tag in HEADINGS or (heading and not block)
    flush()
    return out


def stop_density(text: str) -> float:
    words = [w.strip(".,;:!?\"'()[]#*$%&|") for w in text.lower().split()]
    return sum(w in STOP_WORDS for w in words) / len(words)


def first_pass(blocks: list[Block]) -> list[str]:
    """A label for each block: good, bad, or ambiguous: near (good rather), poor (bad rather) or short.

    Link density, length and stop-word density decide. Where the page's longer blocks
    hold next to no known stop words, the density says nothing, and length decides.
    """
    density = [stop_density(b.text) if len(b.text) >= SHORT else 0.0 for b in blocks]
    told = [(d * len(b.text), len(b.text)) for b, d in zip(blocks, density, strict=True) if len(b.text) >= SHORT and b.linked <= LINKS * len(b.text)]
    known = sum(d for d, _ in told) >= KNOWN * sum(n for _, n in told)
    return [_label(b, d, known) for b, d in zip(blocks, density, strict=True)]


def _label(b: Block, density: float, known: bool) -> str:
    n = len(b.text)
    if b.linked > LINKS * n or ("\xa9" in b.text and not b.article and n < LONG):
        return "bad"
    if n < SHORT:
        return "bad" if b.linked and not b.article else "short"
    if not known:
        return "good" if n > LONG else "near"
    if density >= MANY:
        return "good" if n > LONG or b.article else "near"
    return "near" if density >= FEW else "poor"


def second_pass(blocks: list[Block], first: list[str]) -> list[bool]:
    """Whether to keep each block: ambiguous ones inherit from the nearest decided ones.

    Neighbours are those of the same article, or outside of all; outside, what follows
    an edge or an article's border counts as bad. Near blocks need one good side, or a
    page without any good block; poor ones need two good sides, in an article one. Short
    ones take the side that is nearer; if both are equally near and differ, an article
    keeps, a page doesn't. A heading goes with what follows it. In an article without
    decided blocks all stay.
    """
    n = len(blocks)

    def nearest(order: range) -> list[tuple[int, bool] | None]:
        """Distance and label of the nearest decided block on one side; None for an article's edge."""
        found: list[tuple[int, bool] | None] = [None] * n
        last, article, edge = None, None, order[0] - order.step if n else 0
        for i in order:
            if blocks[i].article != article:
                last, article, edge = None, blocks[i].article, i - order.step
            if last is not None:
                found[i] = abs(i - last), first[last] == "good"
            elif not article:
                found[i] = abs(i - edge), False
            if first[i] in ("good", "bad"):
                last = i
        return found

    before, after = nearest(range(n)), nearest(range(n - 1, -1, -1))
    no_good = "good" not in first
    out = []
    for i, label in enumerate(first):
        sides = [x for x in (before[i], after[i]) if x is not None]
        votes = {g for d, g in sides if d == min(d for d, _ in sides)}
        if label in ("good", "bad"):
            out.append(label == "good")
        elif not sides:
            out.append(True)
        elif label == "near":
            out.append(no_good or any(g for _, g in sides))
        elif label == "poor":
            out.append(any(g for _, g in sides) if blocks[i].article else all(g for _, g in sides))
        else:
            ahead = blocks[i].heading and after[i] is not None and after[i][1]
            out.append(ahead or (votes == {True} if len(votes) == 1 else bool(blocks[i].article)))
    return out


def main_text(page: str) -> str:
    """Kept blocks, joined by a line feed; empty if there are none."""
    blocks = blocks_of(page)
    keep = second_pass(blocks, first_pass(blocks))
    return "\n".join([b.text for b, k in zip(blocks, keep, strict=True) if k])


def extract_text(pages: DataFrame, html_column: str = "html", carry: list[str] | None = None) -> DataFrame:
    """pages with `text` and `n_chars` (code points). Null and empty html give an empty text.

    Columns of pages named text or n_chars are replaced; others stay. Pages are read
    whole, in time linear in their length, unclosed and deeply nested elements included.
    Repeated rows give repeated results; an empty table gives none.
    """

    def make():
        def work(column):
            texts = [main_text(p) for p in strings(column)]
            return [pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())]

        return work

    return arrow_columns(pages, [html_column], struct(("text", T.StringType()), ("n_chars", T.LongType())), make, carry)


def page_texts(pages: DataFrame) -> DataFrame:
    return extract_text(pages.select("page_id", "url", F.col("html")), carry=["page_id", "url"])
