"""Main text of web pages by block rules in two passes.

Markup is cut into blocks of text. Pass one decides each block by its own stop-word density, length and link density:
good, bad, or undecided where it is short or its densities lie between. Pass two gives an undecided block the label of
its nearest decided neighbours. What the page itself says comes in as follows:

* Blocks inside furniture (menus, headers, footers, sidebars, notices, adverts, forms, reader comments, by element, role,
  class or id) are bad. A class or id counts by its whole words, and never on an element that holds most of the text that
  the densities call good.
* Where a page marks its article or main part, blocks outside it are bad, and inside it none is: those that the densities
  don't call good are undecided there and inherit from their neighbours, or are good where that part has no decided block. Marks
  that hold less than a third of the text that the densities call good (teasers, say) are passed over.

Character references are decoded, white space inside a block becomes one space, blocks are trimmed and joined in page
order by an empty line. Defined results: null and empty pages, and pages without text, give the empty string; repeated
rows give a row each; extra columns pass through, but for one named like the result, which replaces it; an unclosed element
ends with what holds it; a quote that isn't closed ends with its tag, and a tag that isn't closed is text. Time is linear in a
page's length, whatever its markup.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm import common

# Thresholds of pass one.
SHORT = 70
LONG = 200
STOP_LOW = 0.15
STOP_HIGH = 0.28
LINKS = 0.33

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++)))?""")

#: Elements whose content isn't text; they are passed over up to their end tag.
RAW = frozenset("script style noscript template textarea iframe svg math object canvas title select xmp noembed noframes".split())
FURNITURE = frozenset("nav header footer aside form menu dialog button fieldset datalist audio video".split())
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var".split()
)
MAIN = frozenset("article main".split())
ROLES = frozenset("navigation banner contentinfo complementary search dialog alert alertdialog menu menubar toolbar form".split())
#: Classes and ids that mark furniture: as a whole, or as the first or last word of a compound ("comment-list", "main-nav").
HINTS = frozenset(
    "ad ads advert adverts advertisement advertising adsense banner sponsor sponsored promo promotion cookie cookies consent gdpr notice notices "
    "notification alert popup modal overlay sidebar nav navbar navigation menu menubar topbar breadcrumb breadcrumbs footer header masthead "
    "comment comments respond disqus reply replies share sharing social related recommended newsletter subscribe subscription signup login search "
    "pagination pager widget toolbar copyright legal".split()
)
#: Those that count as a whole only.
WHOLE = frozenset("side hidden skip".split())
#: Words that turn a compound into something else ("has-sidebar", "no-comments").
OTHERWISE = frozenset("has no not non without with is js hide show".split())

#: Words that leave a compound of furniture what it is ("comment-list", "sidebar-right"); with other words it is only a hint.
PLAIN = frozenset(
    "a area author bar block body bottom box btn button buttons center col column container content count desktop entry field fixed footer form frame "
    "global group head header heading holder home icon icons id img inner inside item items large layer left link links list main menu meta "
    "mobile module nav off on outer page pane panel primary region right row secondary section site slot small sticky sub text thread title toggle "
    "top ul unit user view wide wrap wrapper zone".split()
)

STOP = frozenset(
    # English, French, German, Spanish, Italian, Portuguese, Dutch
    "a about after all also an and any are as at be because been but by can could did do for from had has have he her his how i if in into is it its "
    "just like more my new no not of on one only or other our out over she so some than that the their them then there these they this to up was we "
    "were what when which who will with would you your "
    "au aux avec ce ces cette dans de des du elle en est et eux il ils je la le les leur lui mais me même mes moi mon ne nos nous on ou par pas plus "
    "pour qu que qui sa se ses son sont sur ta te tu un une vos votre vous été être a ont où comme "
    "aber als am an auch auf aus bei bin bis da das dass dem den der des die dies diese durch ein eine einem einen einer eines er es für hat ich ihr im "
    "in ist ja kann mit nach nicht noch nur oder sich sie sind so über um und uns unter vom von vor war was wenn werden wie wir wird zu zum zur "
    "al como con cuando de del desde donde el ella en entre era es esta este esto fue ha hasta la las lo los más me mi muy no nos o para pero por "
    "porque que quien se ser si sin sobre son su sus también te un una uno y ya "
    "che di da il gli nel della delle dei non per una sono come anche questo più "
    "os das dos em um uma não com seu sua mais foi pela pelo ao "
    "het een van ik te dat niet zijn op aan met voor er om dan zou wat mijn men dit zo door ze naar".split()
)

_WORD = re.compile(r"[^\W\d_]+")


class _Block:
    __slots__ = ("text", "links", "main", "furniture", "hints")

    def __init__(self, text: str, links: int, main: bool, furniture: bool, hints: tuple[int, ...]):
        self.text, self.links, self.main, self.furniture, self.hints = text, links, main, furniture, hints


def _hinted(value: str) -> int:
    """Whether a class or id names furniture: 2, hints at it: 1, or neither: 0."""
    found = 0
    for token in value.split():
        words = [w for w in re.split(r"[^a-z]+", re.sub(r"([a-z])([A-Z])", r"\1 \2", token).lower()) if w]
        if token.lower() in WHOLE or words and words[0] not in OTHERWISE and (words[0] in HINTS or words[-1] in HINTS):
            found = max(found, 2 if all(w in HINTS or w in PLAIN or w in WHOLE for w in words) else 1)
    return found


def _marks(name: str, attributes: str) -> tuple[bool, int, bool]:
    """Whether an element is furniture, hinted at as such by a class or id (1: by a word of a compound, 2: as a whole), or the main part."""
    furniture, hinted, main = name in FURNITURE, 0, name in MAIN
    if attributes and name not in ("html", "body"):
        for key, a, b, c in _ATTRIBUTE.findall(attributes):
            key, value = key.lower(), a or b or c
            if key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "role" and value.lower() in ROLES:
                furniture = True
            elif key == "role" and value.lower() == "main":
                main = True
            elif key in ("class", "id") and name not in MAIN:
                hinted = max(hinted, _hinted(value))
    return furniture, hinted, main


class _Tags:
    """The tags of a page, one after the other. Nothing is looked for twice past the place where it was last found."""

    def __init__(self, html: str):
        self.html = html
        self.last = html.rfind(">")
        self.none: set[str] = set()  # what doesn't occur any more

    def find(self, what: str, at: int) -> int:
        if what in self.none:
            return -1
        found = self.html.find(what, at)
        if found < 0:
            self.none.add(what)
        return found

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(begin, end, element, whether it closes one, attributes) of the next tag; for comments and the like an empty element, for CDATA its text."""
        html = self.html
        while 0 <= (at := self.find("<", at)) < self.last:
            second = html[at + 1 : at + 2]
            if second == "!" and html.startswith("<!--", at):
                end = self.find("-->", at + 4)
                return at, len(html) if end < 0 else end + 3, "", False, ""
            if second == "!" and html.startswith("<![CDATA[", at) and (end := self.find("]]>", at + 9)) >= 0:
                return at, end + 3, "", False, html[at + 9 : end]
            if second and second in "!?":
                return at, html.index(">", at) + 1, "", False, ""
            closing = second == "/"
            if name := _NAME.match(html, at + 1 + closing):
                end = self.end(name.end())
                return at, end + 1, name[0].lower(), closing, html[name.end() : end]
            at += 1
        return None

    def end(self, at: int) -> int:
        """Where the tag ends whose attributes begin here: at the next > outside quotes, or inside one that isn't closed."""
        html = self.html
        first = place = html.index(">", at)
        while True:
            quotes = [q for q in (html.find('"', at, place), html.find("'", at, place)) if q >= 0]
            if not quotes:
                return place
            close = self.find(html[min(quotes)], min(quotes) + 1)
            if close < 0 or close > self.last:
                return first
            at = close + 1
            if at > place:
                place = html.index(">", at)


class _Open:
    """The open elements, with the places of each kind, so that none is looked for among all."""

    def __init__(self) -> None:
        self.stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # element; inside main part, furniture and hinted elements, before it
        self.places: dict[str, list[int]] = {}
        self.blocks: list[int] = []  # of elements that aren't inline
        self.bars: list[int] = []  # of those that aren't paragraphs either

    def push(self, name: str, *state) -> None:
        place = len(self.stack)
        self.stack.append((name, *state))
        self.places.setdefault(name, []).append(place)
        if name not in INLINE:
            self.blocks.append(place)
            if name != "p":
                self.bars.append(place)

    def place(self, name: str) -> int:
        return self.places[name][-1] if self.places.get(name) else -1

    def close(self, place: int) -> tuple:
        """End the element at a place and all in it; what held before it."""
        state = self.stack[place][1:]
        while len(self.stack) > place:
            self.places[self.stack.pop()[0]].pop()
        for held in (self.blocks, self.bars):
            while held and held[-1] >= place:
                held.pop()
        return state


def blocks(html: str) -> list[_Block]:
    """The text blocks of a page in order."""
    out: list[_Block] = []
    text: list[str] = []
    links = 0
    tags, open_ = _Tags(html), _Open()
    main = furniture = False
    hints: tuple[int, ...] = ()  # the outermost hinted elements that the place is in, two at most of either kind; negative: only hinted at
    hinted_so_far = 0
    in_link = 0
    at = 0

    def flush() -> None:
        nonlocal links
        if text:
            joined = " ".join(unescape("".join(text)).split())
            if joined:
                out.append(_Block(joined, links, main, furniture, hints))
            text.clear()
        links = 0

    while tag := tags.next(at):
        begin, end, name, closing, attributes = tag
        if begin > at:
            piece = html[at:begin]
            text.append(piece)
            if in_link:
                links += len(" ".join(unescape(piece).split()))
        at = end
        if not name:
            if attributes:
                text.append(attributes.replace("&", "&amp;"))
            continue
        if name in RAW:
            if not closing and not attributes.endswith("/"):
                close = _ends[name].search(html, at)
                at = close.end() if close else len(html)
            continue
        if name == "br":
            text.append(" ")
            continue
        if name in VOID:
            if name == "hr":
                flush()
            continue
        inline = name in INLINE
        if not inline:
            flush()
            in_link = 0
        if closing:
            if name == "a":
                in_link = 0
            place = open_.place(name)
            if place >= 0 and (not inline or not open_.blocks or open_.blocks[-1] < place):
                if inline and (furniture, hints) != open_.stack[place][2:]:
                    flush()
                main, furniture, hints = open_.close(place)
            continue
        if name == "a":
            in_link = 1
        if name in ("p", "li", "dt", "dd", "tr", "td", "th", "option"):  # these end one of their own kind left open
            place = open_.place(name)
            if place >= 0 and (not open_.bars or open_.bars[-1] <= place):
                main, furniture, hints = open_.close(place)
        marked, hinted, in_main = _marks(name, attributes)
        if inline and (marked or hinted):
            flush()
        if not attributes.endswith("/") or inline:
            open_.push(name, main, furniture, hints)
            furniture = furniture or marked
            main = main or in_main
            if hinted and sum((h > 0) == (hinted == 2) for h in hints) < 2:
                hinted_so_far += 1
                hints = (*hints, hinted_so_far if hinted == 2 else -hinted_so_far)
    if at < len(html):
        text.append(html[at:])
    flush()
    return out


_ends = {name: re.compile(rf"</{name}(?![^\s/>])[^>]*+>", re.I) for name in RAW}


def density(block: _Block) -> int:
    """1 good, -1 bad, 0 undecided, by a block's stop words, length and links alone."""
    size = len(block.text)
    if block.links > LINKS * size:
        return -1
    words = _WORD.findall(block.text.lower())
    stops = sum(map(STOP.__contains__, words)) / len(words) if words else 0.0
    if size < SHORT:
        return -1 if block.links > 0 and stops < STOP_LOW else 0
    if stops >= STOP_HIGH:
        return 1 if size >= LONG or stops >= STOP_HIGH + 0.04 else 0
    return 0 if stops >= STOP_LOW else -1


def first_pass(found: list[_Block]) -> tuple[list[int], list[str]]:
    """1 good, -1 bad, 0 undecided, for each block, and what decided it: furniture, position or density."""
    own = [density(b) for b in found]
    good = [len(b.text) if d == 1 else 0 for b, d in zip(found, own, strict=True)]

    def holds(furniture: list[bool]) -> tuple[list[bool], bool]:
        """The blocks of the marked part, and whether it counts."""
        main = [b.main and not f for b, f in zip(found, furniture, strict=True)]
        rest = sum(g for g, f in zip(good, furniture, strict=True) if not f)
        return main, any(main) and 3 * sum(g for g, m in zip(good, main, strict=True) if m) >= rest

    # An element that is only hinted at as furniture isn't, where it holds a block that the densities call good.
    real = {h for b, d in zip(found, own, strict=True) if d == 1 and not b.furniture and not any(h > 0 for h in b.hints) for h in b.hints}
    furniture = [b.furniture or any(h not in real for h in b.hints) for b in found]
    main, marked = holds(furniture)
    if not marked:  # then a class or id may be wrong
        held: dict[int, int] = {}
        for b, size in zip(found, good, strict=True):
            for h in b.hints:
                held[h] = held.get(h, 0) + size * (not b.furniture)
        most = sum(g for b, g in zip(found, good, strict=True) if not b.furniture)
        furniture = [b.furniture or any(h not in real and 2 * held[h] <= most for h in b.hints) for b in found]
        main, marked = holds(furniture)
    labels, rules = [], []
    for b, d, f, m in zip(found, own, furniture, main, strict=True):
        inside = -1 if b.links > LINKS * len(b.text) and len(b.text) >= SHORT else max(d, 0)
        label, rule = (-1, "furniture") if f else (-1, "position") if marked and not m else (inside, "density") if marked else (d, "density")
        labels.append(label)
        rules.append(rule if label else "neighbours")
    if marked and not any(label == 1 for label, m in zip(labels, main, strict=True) if m):
        labels = [1 if m and not label else label for label, m in zip(labels, main, strict=True)]
        rules = ["position" if m and label == 1 else rule for rule, label, m in zip(rules, labels, main, strict=True)]
    elif marked:  # the neighbours of a block of the marked part are those of that part
        inside = iter(second_pass([label for label, m in zip(labels, main, strict=True) if m]))
        labels = [(1 if next(inside) else -1) if m else label for label, m in zip(labels, main, strict=True)]
    return labels, rules


def second_pass(labels: list[int]) -> list[bool]:
    """Undecided blocks take the label of the nearest decided neighbours: of both where they agree, else of the nearer one; good wins a tie."""
    before: list[tuple[int, int]] = []
    last = (-1, 1 << 30)
    for label in labels:
        last = (label, 0) if label else (last[0], last[1] + 1)
        before.append(last)
    out, last = [], (-1, 1 << 30)
    for k in range(len(labels) - 1, -1, -1):
        last = (labels[k], 0) if labels[k] else (last[0], last[1] + 1)
        a, b = before[k], last
        out.append(labels[k] == 1 if labels[k] else (a[0] == 1 if a[0] == b[0] else (a if a[1] < b[1] else b if b[1] < a[1] else (1, 0))[0] == 1))
    return out[::-1]


def main_text(html: str | None) -> str:
    return "\n\n".join(text for text, keep, _ in decided(html) if keep)


def decided(html: str | None) -> list[tuple[str, bool, str]]:
    """(text, whether it stays, what decided) of each block: furniture, position, density or neighbours."""
    if not html:
        return []
    found = blocks(html)
    labels, rules = first_pass(found)
    return [(b.text, keep, rule) for b, keep, rule in zip(found, second_pass(labels), rules, strict=True)]


def extract(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """The pages with `into` in place of the html. One narrow pass."""
    kept = [f for f in pages.schema.fields if f.name not in (html, into)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(v) for v in batch.column(html).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(f.name) for f in kept] + [pa.array(texts, pa.string())], names=[f.name for f in kept] + [into])

    return common.mapped(pages, run, T.StructType([*kept, T.StructField(into, T.StringType())]), __name__)
