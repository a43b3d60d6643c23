"""Main text of web pages by line-block distribution.

Markup is stripped to lines, one for each block of text.  The lengths of lines are summed over a sliding
window; where the sums surge the text begins, where they dive it ends, and what lies between is kept.
Lines of links count as empty.  Names and elements of places that do not hold the text (menus, forms, notices, ...)
nominate what they hold, and the distribution weighs that: a nominee with most of the page's text is its frame and
stays.  An article that the page marks is evidence, too: where most of the surging text is inside, lines outside
count as empty.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

#: Elements whose content is no text of the page, elements around the text, and elements that begin or end a block.
RAW = ("script", "style", "noscript", "template", "svg", "iframe", "textarea", "title", "object", "canvas")
ASIDE = ("nav", "header", "footer", "aside", "form", "select", "dialog", "menu", "head")
CORE = ("article", "main")
BLOCKS = (
    "address article aside blockquote body center dd details dialog div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 head header hgroup hr html li main menu nav ol optgroup option p pre "
    "section summary table tbody td tfoot th thead tr ul"
).split()
#: Words in class, id or role that mark a part beside the text.
BESIDE = "ad ads advert advertisement banner breadcrumb breadcrumbs comment comments consent cookie cookies disqus footer header masthead menu modal nav navbar navigation newsletter notice pagination popup promo related replies respond share sharing sidebar social sponsor sponsored subscribe toolbar widget".split()
#: Of these, words with other meanings; words that go with such a part, and words of a text's own header.
DOUBTFUL = "ad header menu modal notice related respond share social widget".split()
PARTS = "bar block body bottom box button buttons container content form inner item items left link links list main outer panel right section site top wrap wrapper".split()
OWN = "article content entry page post section story title".split()
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")

#: An attribute: its name, and a value in quotes or without.  Quotes elsewhere are plain characters.
_ATTRIBUTE = re.compile(r"([^\s=>/][^\s=>/]*)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]*)))?|/(?!>)|\s+|=")
_BARE = re.compile(r"<(/?)([a-zA-Z][a-zA-Z0-9:-]*)>")
_NAME = re.compile(r"[a-zA-Z][a-zA-Z0-9:-]*")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_BESIDE, _BLOCKS, _ASIDE, _CORE, _VOID, _RAW, _DOUBTFUL, _PARTS, _OWN = map(frozenset, (BESIDE, BLOCKS, ASIDE, CORE, VOID, RAW, DOUBTFUL, PARTS, OWN))
#: First parts of names that tell of a part that is not there, or elsewhere.
_WITHOUT = frozenset(("no", "has", "with", "without", "hide"))
#: Content that is never text, also where the element is left open; other RAW elements are then only tags.
_CODE = ("script", "style")
#: Closing one of these elements does not close what is open around them.
_SCOPES = _ASIDE | _CORE | {"div", "section", "body", "html", "table", "ul", "ol"}
_HEADINGS = frozenset(("h1", "h2", "h3", "h4", "h5", "h6"))


#: How a nominee is weighed.
NONE, HIDDEN, SURE, DOUBT, HEADER = range(5)


def _nominated(attributes: dict[str, str], first: bool = False) -> int:
    """What class, id or role say of an element (``first``: by a part that begins a name), or that it is hidden.

    A part after no, has or with tells of something else: ``has-sidebar`` is not beside.  A doubtful word beside a word
    of another kind is a doubt: ``share-price``; a header of the text's own is told apart: ``post-header``.
    """
    if "hidden" in attributes or attributes.get("aria-hidden", "").strip().lower() == "true" or _NONE.search(attributes.get("style", "")):
        return HIDDEN
    found = NONE
    for key in ("class", "id", "role"):
        for name in attributes.get(key, "").lower().split():
            parts = [p for p in re.split(r"[_:-]+", name) if p]
            for part in parts:
                if part in _BESIDE:
                    others = [p for p in parts if p != part and p not in _BESIDE and not p.isdigit()]
                    if part == "header" and any(p in _OWN for p in others):
                        kind = HEADER
                    else:
                        kind = DOUBT if part in _DOUBTFUL and any(p not in _PARTS for p in others) else SURE
                    found = SURE if SURE in (kind, found) else found or kind
                    break
                if first or part in _WITHOUT:
                    break
    return found


class Token(NamedTuple):
    """Text (without a name), or a tag; ``end`` for a closing or, with ``</``, an ignored one, ``closed`` for ``<x/>``."""

    text: str
    name: str = ""
    end: bool = False
    closed: bool = False
    attributes: dict[str, str] = {}  # noqa: RUF012


def tokens_of(page: str) -> Iterator[Token]:
    """The page's texts and tags in order; comments and the content of RAW elements are left out.

    Each place is read a bounded number of times, whatever is left open.  A ``<`` that begins no tag is
    text, and so is all that follows a tag which never ends.
    """
    lower = page.lower()
    if len(lower) != len(page):  # some letters grow
        lower = page
    at, n, missing = 0, len(page), set()
    while at < n:
        start = page.find("<", at)
        if start < 0:
            yield Token(page[at:])
            return
        if start > at:
            yield Token(page[at:start])
        bare = _BARE.match(page, start)
        if bare and (bare[1] or bare[2].lower() not in _RAW):
            yield Token("", bare[2].lower(), bool(bare[1]))
            at = bare.end()
            continue
        if page.startswith("<!--", start):
            end = page.find("-->", start + 4)
            at = end + 3 if end >= 0 else n
            continue
        if page.startswith(("<!", "<?"), start):
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        closing = page.startswith("</", start)
        name = _NAME.match(page, start + 1 + closing)
        if not name and closing:
            end = page.find(">", start)
            at = end + 1 if end >= 0 else n
            continue
        if not name:
            yield Token("<")
            at = start + 1
            continue
        attributes: dict[str, str] = {}
        k = name.end()
        while k < n and page[k] != ">" and not page.startswith("/>", k):
            found = _ATTRIBUTE.match(page, k)
            if not found or found.end() == k:
                break
            if found[1]:
                attributes.setdefault(found[1].lower(), next((g for g in found.groups()[1:] if g is not None), ""))
            k = found.end()
        closed = page.startswith("/>", k)
        if not closed and not page.startswith(">", k):
            yield Token(page[start:])
            return
        at = k + 2 if closed else k + 1
        tag = name[0].lower()
        if tag in _RAW and not closing and not closed:
            end = -1 if tag in missing else lower.find(f"</{tag}", at)
            if end >= 0:
                after = page.find(">", end)
                at = after + 1 if after >= 0 else n
            else:
                missing.add(tag)
                at = n if tag in _CODE else at
            yield Token(" ")
            continue
        yield Token("", tag, closing, closed, attributes)


class Line(NamedTuple):
    """A block: whether it stands beside the main text, the article it is in (0: none), the element that holds it, whether all of it is links."""

    text: str
    beside: bool
    core: int
    place: int
    linked: bool


class Nominee:
    """An element that may stand beside the text: how it was named, its characters, those of them in links, and what it holds."""

    __slots__ = ("chars", "heads", "kind", "linked", "around", "valid")

    def __init__(self, kind: int, around: Nominee | None):
        self.kind, self.around, self.chars, self.linked, self.heads, self.valid = kind, around, 0, 0, False, False

    def weigh(self, whole: int) -> None:
        """Whether it is left out, on a page of ``whole`` characters outside links.

        A frame stays: an element with nine tenths of the text, or with half of it and a first heading or an article
        that no inner nominee holds.  A doubt is left out only if half of it or more is links.
        """
        own = self.chars - self.linked
        frame = 10 * own > 9 * whole or 2 * own > whole and self.heads
        doubt = self.kind == DOUBT and 2 * self.linked < self.chars
        self.valid = self.kind == HIDDEN or not (frame or doubt or self.kind == HEADER and self.heads) or bool(self.around and self.around.valid)


def lines_of(page: str) -> list[Line]:
    """The page's blocks in order.

    The header of an article itself counts as text: headings are part of it.  Headings never count as links.  A block
    of nothing but buttons is no text; a button within a sentence is.  Time is linear in the page: each open element is
    found by its name and closed once, and a block is counted for the innermost nominee, whose sums go outwards once.
    """
    out: list[tuple[str, Nominee | None, int, int, bool]] = []
    nominees: list[Nominee] = []
    open_: list[tuple[str, Nominee | None, int, int]] = []  # element, and nominee, core, place around it
    places_of: dict[str, list[int]] = defaultdict(list)  # of the open elements of a name
    scopes: list[int] = []  # places of the open elements that others do not close
    nominee: Nominee | None = None
    link = heading = plain = pressed = shown = False
    core = place = places = whole = 0
    held: list[str] = []

    def flush() -> None:
        nonlocal plain, shown, whole
        if held:
            text = " ".join(html.unescape("".join(held)).split())
            if text and shown:
                linked = not (plain or heading or core)
                out.append((text, nominee, core, place, linked))
                if nominee:
                    nominee.chars += len(text)
                    nominee.linked += len(text) * (not plain)
                whole += len(text) * plain
            held.clear()
        plain = shown = False

    def close(to: int) -> None:
        nonlocal nominee, core, place
        while len(open_) > to:
            name, nominee, core, place = open_.pop()
            places_of[name].pop()
            if scopes and scopes[-1] == len(open_):
                scopes.pop()

    for t in tokens_of(page):
        name = t.name
        if not name:
            held.append(t.text)
            some = not t.text.isspace()
            plain = plain or not link and some and not pressed
            shown = shown or some and not pressed
            continue
        if name == "br":
            held.append(" ")
        if name == "a":
            link = not t.end
        if name == "button":
            pressed = not t.end
        if name in _BLOCKS:
            flush()
            if name in _HEADINGS:
                heading = not t.end
                if name == "h1" and heading and nominee:
                    nominee.heads = True
        if name in _VOID:
            continue
        if t.end:
            if places_of[name] and (name in _SCOPES or not scopes or scopes[-1] <= places_of[name][-1]):
                flush()
                close(places_of[name][-1])
        elif not t.closed:
            kind = NONE if name in ("html", "body", "main") else _nominated(t.attributes, name == "article")
            if name in _ASIDE and not (name == "header" and core) and kind != HIDDEN:
                kind = SURE
            if name in _CORE and not kind and nominee:
                nominee.heads = True
            if name in _BLOCKS or kind or places_of[name]:
                if name == "p" and open_ and open_[-1][0] == "p":
                    close(len(open_) - 1)
                if kind and name not in _BLOCKS:
                    flush()
                places_of[name].append(len(open_))
                if name in _SCOPES:
                    scopes.append(len(open_))
                open_.append((name, nominee, core, place))
                if kind:
                    nominee = Nominee(kind, nominee)
                    nominees.append(nominee)
                if name in _SCOPES:
                    places += 1
                    place = places
                    core = core or place * (name in _CORE)
    flush()
    for x in reversed(nominees):  # inner ones first
        if x.around:
            x.around.chars += x.chars
            x.around.linked += x.linked
            x.around.heads = x.around.heads or x.heads and x.kind in (HEADER, DOUBT)
    for x in nominees:
        x.weigh(whole)
    return [Line(text, bool(n and n.valid), c, p, linked) for text, n, c, p, linked in out]


def _sums(sizes: list[int], window: int) -> list[int]:
    return [sum(sizes[k : k + window]) for k in range(len(sizes))]


def _surging(sums: list[int], sizes: list[int], window: int, surge: int) -> set[int]:
    """The places of the lines within windows whose sum exceeds ``surge``."""
    return {j for k, total in enumerate(sums) if total > surge for j in range(k, min(k + window, len(sizes))) if sizes[j]}


def _marked(lines: list[Line], window: int, surge: int) -> bool:
    """Whether articles hold at least as much of the page's surging text as lies outside them (of all text, where none surges)."""
    if not any(x.core and not x.beside for x in lines):
        return False
    sizes = [0 if x.beside else len(x.text) for x in lines]
    counted = _surging(_sums(sizes, window), sizes, window, surge) or range(len(sizes))
    inside = sum(sizes[k] for k in counted if lines[k].core)
    return 2 * inside >= sum(sizes[k] for k in counted)


def _chosen(lines: list[Line], sizes: list[int], marked: bool, window: int, surge: int, dive: int) -> list[int]:
    """The places of the lines that are text; ``sizes`` is 0 for lines that cannot be.

    Text runs from the first window whose sum exceeds ``surge`` to the first window after the last one whose sum is
    below ``dive``; lines of links count nothing in these sums.  Short lines right before it, and short lines anywhere
    in an element that directly holds lines of such windows (``marked``: in their article), belong to it unless they
    are links that lead to it or stand apart.  Without a surge all lines are text.
    """
    weights = [0 if x.linked else n for x, n in zip(lines, sizes, strict=True)]
    sums = _sums(weights, window)
    surges = [k for k, total in enumerate(sums) if total > surge]
    if not surges:
        return [k for k, n in enumerate(sizes) if n]
    start, end = surges[0], surges[-1]
    behind = max(range(end, min(end + window, len(weights))), key=weights.__getitem__)  # the last surge's longest line
    while end < len(sums) and (end <= behind or sums[end] >= dive):
        end += 1
    while not weights[start]:  # links at the edge of the window
        start += 1
    low = start
    while low and weights[low - 1]:
        low -= 1
    while low < start and lines[low].linked:
        low += 1
    place = [x.core if marked else x.place for x in lines]
    held = {place[k] for k in _surging(sums, weights, window, surge) if k <= behind}
    return [k for k, n in enumerate(sizes) if n and (low <= k < end or place[k] in held and not lines[k].linked)]


def text_of(page: str | None, window: int = 3, surge: int = 80, dive: int = 24) -> str:
    """The main text: blocks joined by empty lines; empty for a null or empty page.

    The text runs from the first window whose sum exceeds ``surge`` characters to the dive after the last one, where
    a sum is below ``dive``, however many blocks beside the text lie between, with the short blocks that belong to it;
    it is all text where no window surges.  Blocks outside articles are left out where articles hold at least half of
    the surging text, and blocks of an article that has some of it belong to it.
    """
    lines = lines_of(page or "")
    marked = _marked(lines, window, surge)
    sizes = [len(x.text) if not x.beside and (x.core or not marked) else 0 for x in lines]
    return "\n\n".join(lines[k].text for k in _chosen(lines, sizes, marked, window, surge, dive))


def extract(pages: DataFrame, html_col: str = "html", keep: tuple[str, ...] = ("page_id", "url")) -> DataFrame:
    """The columns ``keep``, ``text`` and ``n_chars`` (its code points) of every page.

    A null or empty page has an empty text; so has one without text.  Pages stand alone: repeated rows get
    equal texts, nothing is shuffled, and other columns are ignored.
    """
    kinds = dict(pages.dtypes)
    own = pages.select(*(pages[c].alias(f"c{k}") for k, c in enumerate(keep)), pages[html_col].alias("page"))
    schema = ", ".join([f"c{k} {kinds[c]}" for k, c in enumerate(keep)] + ["text string", "n_chars long"])

    def each(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = [text_of(p) for p in batch.column(len(keep)).to_pylist()]
        return pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())], [f"c{k}" for k in range(len(keep))] + ["text", "n_chars"])

    return arrow_map(own, each, schema, 500).toDF(*keep, "text", "n_chars")
