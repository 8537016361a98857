"""Main text of web pages by tree scoring (operator 12).

A page becomes a tree of its block elements.  Elements that can't hold the article by what they are or are called (menus, page headers and footers,
asides, forms, scripts, adverts, notices, reader comments) are taken out.  Each paragraph then earns a point, a point a comma and a
point for every 100 characters up to three, discounted by the share of its characters inside links, and passes them to its ancestors: whole to the nearest
container, half to the next, a third of what is left per level beyond.  Containers are discounted by their own link density.  The best container is kept,
with its siblings that score like it or read like paragraphs.  Where a page has ``article`` or ``main`` elements, only they are looked
into, and the one that the best container stands in is the container.  Inner elements that are links and nothing else are menus.

A block's text has its character references decoded and each run of white space turned into one space; blocks that are not empty are joined in page
order by one newline.  Line breaks inside a block are white space.

Markup needn't be well formed: tags that are never closed end with their container, a paragraph ends where the next block begins, an unclosed
comment or script runs to the end, elements nest up to 512 deep, a tag cut off by the page's end is no text.  A page's work is linear in its length.  Null and empty pages give empty texts; rows
with a null id or url pass through; repeated rows are extracted each on its own; other columns are ignored; an empty table gives an empty table.  Each page
is taken alone in a map task, so there is nothing to shuffle and no group to grow.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import _vec as V
from ._worker import task

#: Elements whose content is no markup.
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
#: Elements that never hold article text.
DROPPED = frozenset(
    "script style textarea title xmp iframe noembed noframes head noscript template nav aside footer form menu dialog select button object canvas svg math audio video map datalist".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Elements that begin a block of text.
BLOCKS = DROPPED | HEADINGS | frozenset(
    "html body article main section header hgroup div p ul ol li dl dt dd table thead tbody tfoot tr td th caption blockquote pre figure figcaption address details summary fieldset legend center search".split()
)
#: Blocks that hold a paragraph of their own rather than others.
PARAGRAPHS = HEADINGS | frozenset("p li dt dd td th caption pre figcaption address summary legend blockquote".split())
#: What an opening tag ends, and the elements beyond which it ends nothing.
ENDS = {
    "li": (frozenset(["li"]), frozenset("ul ol menu".split())),
    "dt": (frozenset("dt dd".split()), frozenset(["dl"])),
    "dd": (frozenset("dt dd".split()), frozenset(["dl"])),
    "tr": (frozenset("tr td th caption".split()), frozenset(["table"])),
    "td": (frozenset("td th".split()), frozenset("tr table".split())),
    "th": (frozenset("td th".split()), frozenset("tr table".split())),
    "tbody": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "thead": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "tfoot": (frozenset("thead tbody tfoot tr td th caption".split()), frozenset(["table"])),
    "body": (frozenset(["head"]), frozenset(["html"])),
}
#: Words of class names, ids and roles that name what isn't article text.
UNWANTED = frozenset(
    "ad ads adsense advert adverts advertisement advertisements advertising adbox adslot sponsor sponsored sponsors promo promos promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications popup modal overlay newsletter subscribe subscription signup login paywall "
    "sidebar sidebars aside rail nav navbar navigation navigate menu menus submenu breadcrumb breadcrumbs pagination pager toc topbar toolbar masthead footer footers colophon "
    "related recommended recommendations recommend teaser teasers outbrain taboola "
    "share sharing social widget widgets search skip alert hidden sr print copyright tags taglist complementary contentinfo alertdialog".split()
)
#: Words that name reader comments, inside which no element is the article.
TALK = frozenset("comment comments commentlist disqus respond reply replies discussion".split())
#: Elements nest so deep at most, as in browsers; what would stand deeper stands beside the deepest.
DEPTH = 512
#: A name that begins with one of these words tells of another element, as in ``with-sidebar``.
TELLS = frozenset("with has no without is not hide show content main page".split())
COMMAS = re.compile(r"[,،、，;；]")
_WORDS = re.compile(r"[a-z]+")
_CAMEL = re.compile(r"(?<=[a-z])(?=[A-Z])")
_NAME = re.compile(r"[^\s/>]+")
_ATTRIBUTE = re.compile(r"""\b(class|id|role|hidden|aria-hidden|style|itemprop)\b(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+)))?""", re.I)
_QUOTE = re.compile(r"[>\"']")


@dataclass(slots=True)
class Element:
    """A block element: its tag, the runs of text and elements it holds in order, and whether it is taken out."""

    tag: str
    parent: Element | None
    dropped: bool = False
    children: list = field(default_factory=list)
    depth: int = 0
    talk: bool = False
    article: bool = False
    held_article: bool = False
    chars: int = 0
    linked: int = 0
    links: int = 0
    points: float = 0.0

    def density(self) -> float:
        return self.linked / self.chars if self.chars else 0.0


@dataclass(slots=True)
class Run:
    """A run of inline text: its pieces as they stand, and characters of them inside links."""

    pieces: list
    links: int = 0
    text: str = ""
    linked: int = 0


def telling_words(names: str) -> set[str]:
    """The first and last words of the names in a class attribute or id, of those that tell of their own element."""
    split = (_WORDS.findall(_CAMEL.sub("-", name).lower()) for name in names.split())
    return {w for words in split if words and words[0] not in TELLS for w in (words[0], words[-1])}


def _attributes(tag: str, raw: str) -> tuple[bool, bool, bool]:
    """Whether an element is unwanted by its attributes, whether it says to be the article, and whether it says to hold comments."""
    unwanted, article, talk = False, tag in ("article", "main"), False
    for m in _ATTRIBUTE.finditer(raw):
        name, value = m[1].lower(), m[2] or m[3] or m[4] or ""
        if name in ("class", "id"):
            words = telling_words(value)
            unwanted |= not words.isdisjoint(UNWANTED)
            talk |= not words.isdisjoint(TALK)
        elif name == "role":
            role = value.strip().lower()
            unwanted |= role in UNWANTED or role in ("search", "form", "dialog")
            article |= role in ("main", "article")
        elif name == "itemprop":
            article |= value.strip().lower() == "articlebody"
        elif name == "hidden":
            unwanted |= value.lower() != "until-found" and raw[m.start() - 1 : m.start()].isspace()
        elif name == "aria-hidden":
            unwanted |= value.strip().lower() == "true"
        else:
            unwanted |= re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) is not None
    return unwanted or talk, article, talk


class Page:
    """The tree of a page's block elements, built in one pass over its tags."""

    def __init__(self, html: str):
        low = html.lower()
        self.html, self.low = html, low if len(low) == len(html) else html
        self.root = self.at = Element("html", None)
        self.run: Run | None = None
        self.link: Element | None = None
        #: Characters of which none is left in the page, so that no tag looks for them again.
        self.gone: set[str] = set()
        self._parse()

    def _text(self, raw: str) -> None:
        if self.run is None:
            if raw.isspace():
                return
            self.run = Run([])
            self.at.children.append(self.run)
        self.run.pieces.append((raw, self.link is not None))

    def _open(self, tag: str, raw: str) -> None:
        self.run = None
        unwanted, article, talk = _attributes(tag, raw) if raw else (False, tag in ("article", "main"), False)
        if self.at.depth >= DEPTH:
            self._close_to(self.at)
        dropped = tag in DROPPED or (unwanted and tag not in ("html", "body", "main"))
        talk |= self.at.talk
        self.at.children.append(e := Element(tag, self.at, dropped, depth=self.at.depth + 1, talk=talk, article=article and not dropped and not talk))
        self.at = e

    def _close_to(self, e: Element) -> None:
        """End every open element down to e, e included."""
        self.run = None
        x = self.at
        while x is not e:
            if x is self.link:
                self.link = None
            x = x.parent
        if e is self.link:
            self.link = None
        self.at = e.parent or e

    def _opened(self, tags: frozenset, stops: frozenset) -> Element | None:
        """The outermost open element of these tags inside the nearest stop."""
        x, found = self.at, None
        while x is not None and x.tag not in stops:
            if x.tag in tags:
                found = x
            x = x.parent
        return found

    def _start(self, tag: str, raw: str) -> None:
        if tag == "br" or tag == "hr":
            if self.run is not None:
                self.run.pieces.append((" ", False))
            if tag == "hr":
                self.run = None
        elif tag == "a":
            self.link = self.at
            if self.run is not None:
                self.run.links += 1
            else:
                self.run = Run([], 1)
                self.at.children.append(self.run)
        elif tag in BLOCKS:
            if tag in ("html", "body") and self.at.tag not in ("head", "html"):
                return
            if tag == "html":
                return
            if self.at.tag == "head" and tag not in DROPPED:
                self._close_to(self.at)
            x = self.at
            if x.tag == "p" or (x.tag in HEADINGS and tag in HEADINGS):
                self._close_to(x)
            if tag in ENDS:
                found = self._opened(*ENDS[tag])
                if found is not None:
                    self._close_to(found)
            self._open(tag, raw)

    def _end(self, tag: str) -> None:
        if tag == "a":
            self.link = None
        elif tag in BLOCKS and tag not in ("html", "body"):
            x = self.at
            while x.parent is not None and x.tag != tag:
                x = x.parent
            if x.tag == tag and x.parent is not None:
                self._close_to(x)
            elif tag == "p":
                self.run = None

    def _tag_end(self, at: int) -> int:
        """Where the tag that holds position ``at`` ends, behind its ``>``; quoted values may hold one.  -1: nowhere."""
        html = self.html
        while m := _QUOTE.search(html, at):
            at = m.end()
            if m[0] == ">":
                return at
            before = m.start() - 1
            while html[before].isspace():
                before -= 1
            if html[before] == "=" and m[0] not in self.gone:
                close = html.find(m[0], at)
                if close < 0:
                    self.gone.add(m[0])
                else:
                    at = close + 1
        return -1

    def _parse(self) -> None:
        html, n, at = self.html, len(self.html), 0
        last = html.rfind(">")
        while at < n:
            less = html.find("<", at)
            if less < 0:
                self._text(html[at:])
                return
            if less > at:
                self._text(html[at:less])
            mark = html[less + 1 : less + 2]
            if html.startswith("<!--", less):
                if html.startswith(("<!-->", "<!--->"), less):
                    at = html.find(">", less) + 1
                    continue
                close = html.find("-->", less + 4)
                at = close + 3 if close >= 0 else n
            elif mark in ("!", "?", "/") or (mark.isascii() and mark.isalpha()):
                if less > last:
                    return
                if mark in "!?" or (mark == "/" and not html[less + 2 : less + 3].isalpha()):
                    at = html.find(">", less) + 1
                    continue
                close = mark == "/"
                m = _NAME.match(html, less + 1 + close)
                tag = m[0].lower()
                stop = self._tag_end(m.end())
                if stop < 0:
                    return
                if close:
                    self._end(tag)
                else:
                    self._start(tag, html[m.end() : stop - 1])
                    if tag in RAW:
                        stop = self._raw_end(tag, stop)
                at = stop
            else:
                self._text("<")
                at = less + 1

    def _raw_end(self, tag: str, at: int) -> int:
        """Where an element without markup inside ends; its content is skipped."""
        close = "</" + tag
        if close in self.gone:
            return len(self.html)
        found = self.low.find(close, at)
        if found < 0:
            self.gone.add(close)
            return len(self.html)
        return found


def _measure(page: Page) -> list[Element]:
    """All elements in page order that stay, with characters, links and points of theirs and theirs below."""
    order, stack = [], [page.root]
    while stack:
        e = stack.pop()
        order.append(e)
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
    for e in reversed(order):
        if e.parent is not None:
            e.parent.held_article |= e.article or e.held_article
    #: With an article outside all that is taken out, an article inside is another one.
    free = any(e.article and not any(x.dropped for x in _above(e)) for e in order)
    out, stack = [], [page.root]
    while stack:
        e = stack.pop()
        if e.dropped and e.tag not in RAW and (e.held_article and not free or e.tag == "form" and _wraps_page(e)):
            e.dropped = False
        if e.tag == "header" and not any(p.article for p in _above(e)) and not e.held_article:
            e.dropped = True
        if e.dropped:
            continue
        out.append(e)
        stack.extend(c for c in reversed(e.children) if isinstance(c, Element))
    for e in reversed(out):
        for c in e.children:
            if isinstance(c, Run):
                c.text = " ".join(unescape("".join(p for p, _ in c.pieces)).split())
                c.linked = min(len(c.text), sum(len(" ".join(unescape(p).split())) for p, inside in c.pieces if inside))
                e.chars += len(c.text)
                e.linked += c.linked
                e.links += c.links
            elif not c.dropped:
                e.chars += c.chars
                e.linked += c.linked
                e.links += c.links
    return out


def _above(e: Element):
    while e.parent is not None:
        e = e.parent
        yield e


def _wraps_page(e: Element) -> bool:
    """Whether a form is the page's only element that holds paragraphs, as with pages that are one form."""
    siblings = e.parent.children if e.parent is not None else []
    others = sum(len(c.children) > 0 for c in siblings if isinstance(c, Element) and c is not e and c.tag not in DROPPED)
    stack = [e]
    while stack:
        x = stack.pop()
        if x.tag == "p":
            return not others
        stack.extend(c for c in x.children if isinstance(c, Element))
    return False


def _own_points(e: Element) -> float:
    texts = [c.text for c in e.children if isinstance(c, Run) and c.text]
    if not texts:
        return 0.0
    chars = sum(map(len, texts))
    linked = sum(c.linked for c in e.children if isinstance(c, Run))
    return (1 + sum(len(COMMAS.findall(t)) for t in texts) + min(chars / 100, 3)) * (1 - linked / chars)


def _is_menu(e: Element) -> bool:
    return e.tag not in PARAGRAPHS and not e.article and e.links >= 3 and e.density() > 0.8


def main_text(html: str | None) -> str:
    """The main text of a page, one block a line."""
    if not html:
        return ""
    page = Page(html)
    kept = _measure(page)
    for e in kept:
        got = _own_points(e)
        if not got:
            continue
        level, x = 0, e.parent if e.tag in PARAGRAPHS and e.parent is not None else e
        while x is not None:
            if x.tag not in PARAGRAPHS:
                x.points += got if not level else got / 2 if level == 1 else got / (3 * level)
                level += 1
            x = x.parent
    inside = [e for e in kept if e.chars and (e.article or any(x.article for x in _above(e)))]
    scored = {id(e): e.points * (1 - e.density()) for e in kept}
    top = max(inside or kept, key=lambda e: scored[id(e)])
    best = scored[id(top)]
    if best <= 0:
        return ""
    own = [x for x in (top, *_above(top)) if x.article]
    whole = set()
    if own:
        named = [x for x in own if x.tag == "article"]
        top = named[-1] if named else own[0]
        best = max(best, scored[id(top)])
        others = top.parent.children if top.parent is not None else []
        whole.update(id(c) for c in others if isinstance(c, Element) and c.article and not c.dropped and scored[id(c)] >= best / 5)
    else:
        level, x = 1, top
        while x.parent is not None:
            _keep_siblings(x, scored, best, level, whole)
            level, x = level + 1, x.parent
    whole.add(id(top))
    return "\n".join(_blocks(page.root, whole))


def _keep_siblings(own: Element, scored: dict[int, float], best: float, level: int, whole: set[int]) -> None:
    """Add the siblings of ``own`` that belong to the article: they score like it, or read like paragraphs beside the best container, or are headings next before."""
    siblings = [c for c in own.parent.children if (isinstance(c, Run) and c.text) or (isinstance(c, Element) and not c.dropped and c.chars)]
    fits = [c is own or _reads_on(c, scored.get(id(c), 0.0), best, level) for c in siblings]
    for i in range(len(siblings) - 2, -1, -1):
        fits[i] |= fits[i + 1] and getattr(siblings[i], "tag", "") in HEADINGS
    whole.update(id(c) for c, fit in zip(siblings, fits, strict=True) if fit and c is not own)


def _reads_on(c: Element | Run, score: float, best: float, level: int) -> bool:
    if isinstance(c, Element) and c.tag not in PARAGRAPHS:
        return score >= max(best / 5, 2) * level and not _is_menu(c)
    if level > 1 or getattr(c, "tag", "") in HEADINGS:
        return False
    chars = len(c.text) if isinstance(c, Run) else c.chars
    return chars >= 80 and c.linked / chars < 0.25 or not c.linked and COMMAS.search(_text_of(c)) is not None


def _text_of(c: Element | Run) -> str:
    return c.text if isinstance(c, Run) else " ".join(x.text for x in c.children if isinstance(x, Run))


def _blocks(root: Element, whole: set[int]):
    """The texts of all runs inside the elements and runs of ``whole``, in page order."""
    stack = [(root, id(root) in whole)]
    while stack:
        x, inside = stack.pop()
        if isinstance(x, Run):
            if inside and x.text:
                yield x.text
        elif not x.dropped and not (inside and _is_menu(x)):
            stack.extend((c, inside or id(c) in whole) for c in reversed(x.children))


def extract_main_text(pages: DataFrame) -> DataFrame:
    """page_id, url, text (the main text, empty if there is none) and n_chars (its code points) of each row of pages."""
    kinds = {f.name: f.dataType.simpleString() for f in pages.schema}

    @task("op12")
    def run(batches):
        for batch in batches:
            for i, j, _, _ in V.chunks(batch.column(2)):
                texts = [main_text(h) for h in batch.column(2).slice(i, j - i).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).slice(i, j - i) for c in range(2)), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], names=["page_id", "url", "text", "n_chars"]
                )

    rows = pages.select("page_id", "url", F.col("html").cast("string").alias("html"))
    return rows.mapInArrow(run, f"page_id {kinds['page_id']}, url {kinds['url']}, text string, n_chars bigint")
