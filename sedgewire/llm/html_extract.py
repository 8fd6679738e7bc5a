"""Main text of web pages by tag-path ratios.

A page is read once, leniently, into blocks: runs of text between block-level tags, each with the path of open
block elements above it. Per path the lengths and punctuation of its blocks are summed; the ratio of a path is
its text per block, raised by punctuation and lowered by links. Ratios are smoothed over neighbouring blocks in page
order and fused with the path's own; paths above the threshold are content. The content node is the common ancestor
of all of it, or of the outermost article and main elements that hold it; every block within it that is not page
furniture is kept, short ones too. So are the headline before it, what stands between, and paragraphs beside it.

Furniture is told by tag (nav, aside, footer, form ...), role, and classes and ids all of whose words are in FURNITURE
below (ids of headings and sections tell nothing). With one such word among others an element does not count for the
content node, and within it goes only if its text is mostly links or its ratio is low.
Defined results: a null or empty html has an empty text; so has a page without blocks of text; unclosed and
misnested tags are closed as browsers do, and media, svg, buttons and the like (EMBEDDED) by the next tag that cannot be
in them, so that no text after them is lost; rows that repeat a page_id are extracted each; extra columns are ignored.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from math import log1p

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedgewire.llm.common import small_batches

# Element names.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe xmp noembed noframes".split())
EMBEDDED = frozenset("template svg math object video audio canvas select button".split())
FOREIGN = frozenset(("svg", "math"))
#: What opens in svg and math closes them, but for what stands in these.
HOSTS = frozenset("foreignobject desc annotation-xml".split())
BREAKS = frozenset("b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li menu meta nobr ol p pre ruby s small span strong strike sub sup table tt u ul var article main section".split())
INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q ruby rb rp rt s samp small span strike strong sub sup time tt u var wbr img picture".split())
DROPPED = frozenset("nav aside footer form menu dialog head fieldset datalist".split())
ROOTS = frozenset(("article", "main"))
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
TEXT = HEADINGS | frozenset("p pre blockquote li dt dd".split())
CLOSES_P = frozenset("address article aside blockquote center details div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hr main menu nav ol p pre section table ul".split())
SIBLINGS = {"li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("tr", "td", "th"), "td": ("td", "th"), "th": ("td", "th"), "option": ("option",), "thead": ("thead", "tbody", "tr", "td", "th"), "tbody": ("thead", "tbody", "tr", "td", "th"), "tfoot": ("thead", "tbody", "tr", "td", "th")}
BLOCKS = CLOSES_P | ROOTS | frozenset(("li", "dt", "dd"))
SCOPES = frozenset("ul ol dl table article main section div body html".split())
# Roles, and words of class and id, of page furniture.
ROLES = frozenset("navigation banner contentinfo complementary search alert alertdialog dialog menu menubar toolbar form".split())
FURNITURE = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense adslot adbox sponsor sponsored sponsors promo promos promoted promotion banner banners "
    "cookie cookies consent gdpr notice notices notification notifications alert popup modal overlay paywall newsletter subscribe subscription signup login signin register "
    "share sharing social related recommend recommended recommendations trending popular sidebar side sidenav rail widget widgets nav navbar navigation menu menus breadcrumb breadcrumbs "
    "footer foot header masthead topbar toolbar pagination pager comment comments commentlist comentarios kommentare commentaires disqus replies reply respond discussion reactions feedback "
    "search searchbox form hidden skip skiplink copyright disclaimer legal outbrain taboola".split()
)
_NEVER = frozenset("html body article main".split())
_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+>?|<(/?)([a-zA-Z][^\s/>]*+)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<(/?)([a-zA-Z][^\s/>]*+)([^>]*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z][\w:-]*+)(?:\s*+=\s*+(?:\"([^\"]*+)\"|'([^']*+)'|([^\s>]++)))?")
_EITHER = {name: re.compile(rf"</?{name}(?=[\s/>])", re.I) for name in EMBEDDED}
_WORDS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|\d+")
_PUNCT = re.compile(r"[.,;:!?…。,、؛،]")
_HIDES = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)


class Element:
    __slots__ = ("closed", "drop", "embedded", "inside", "name", "number", "path", "soft", "up")

    def __init__(self, name: str, up: Element | None, number: int, drop: bool, soft: bool, path: int):
        self.name, self.up, self.number, self.path = name, up, number, path
        self.inside = name in ROOTS or up is not None and up.inside
        self.drop = drop or up is not None and up.drop
        #: The nearest element, here or above, that bears a furniture word among others.
        self.soft: Element | None = self if soft else up.soft if up else None
        #: Whether it is in an element of EMBEDDED or is one, and whether that has an end tag before the next of its kind.
        self.embedded = up is not None and up.embedded
        self.closed = True


class _Stack(list):
    """The open elements. Names and unclosed ones are counted, so that no tag has to look through all of them; paths are
    numbered by their parent's number and their last step, so that none is ever written out."""

    def __init__(self):
        super().__init__()
        self.names: Counter[str] = Counter()
        self.unclosed, self.made, self.paths = 0, 0, {}
        self.push("html", False, False, "")

    def push(self, name: str, drop: bool, soft: bool, label: str, embedded: bool = False, closed: bool = True) -> None:
        up = self[-1] if self else None
        path = self.paths.setdefault((up.path if up else -1, name + label), len(self.paths))
        e = Element(name, up, self.made, drop, soft, path)
        e.embedded, e.closed = e.embedded or embedded, closed
        self.made += 1
        self.names[name] += 1
        self.unclosed += not closed
        self.append(e)

    def cut(self, k: int) -> None:
        for e in self[k:]:
            self.names[e.name] -= 1
            self.unclosed -= not e.closed
        del self[k:]

    def last(self, name: str) -> int:
        """The place of the innermost open element of a name, or 0."""
        return next(k for k in range(len(self) - 1, -1, -1) if self[k].name == name) if self.names[name] else 0


class Block:
    __slots__ = ("at", "chars", "links", "text")

    def __init__(self, at: Element, text: str, links: int):
        self.at, self.text, self.chars, self.links = at, text, len(text), links


def _is_furniture(name: str, attributes: str, inside: bool) -> tuple[bool, bool, str]:
    """Whether a start tag opens furniture; whether it may, by one word among others; and its class for the path."""
    if name in DROPPED or name == "header" and not inside:
        return True, False, ""
    if not attributes.strip():
        return False, False, ""
    found = {m[1].lower(): html.unescape(m[2] or m[3] or m[4] or "") for m in _ATTRIBUTE.finditer(attributes)}
    soft = False
    if name not in _NEVER:
        if "hidden" in found or found.get("aria-hidden", "").lower() == "true" or _HIDES.search(found.get("style", "")) or found.get("role", "").lower() in ROLES:
            return True, False, ""
        #: The ids of headings and sections are made from their text.
        for token in (found.get("class", "") + " " + ("" if name in HEADINGS or name == "section" else found.get("id", ""))).split():
            words = {w.lower() for w in _WORDS.findall(token) if not w.isdigit()}
            if words and words <= FURNITURE:
                return True, False, ""
            soft = soft or bool(words & FURNITURE)
    first = found.get("class", "").split()
    return False, soft, "." + first[0] if first else ""


def blocks(page: str) -> list[Block]:
    """The blocks of text of a page, in order, furniture marked."""
    out: list[Block] = []
    stack, held, links, link_chars = _Stack(), [], 0, 0
    inline_drop = 0
    dropped_inline: list[str] = []
    raw_until, at = None, 0

    def flush() -> None:
        nonlocal link_chars
        if held:
            text = " ".join("".join(held).split())
            held.clear()
            if text:
                out.append(Block(stack[-1], text, min(link_chars, len(text))))
        link_chars = 0

    def text(part: str) -> None:
        nonlocal link_chars
        if part and not inline_drop and not stack[-1].embedded:
            part = html.unescape(part) if "&" in part else part
            held.append(part)
            if links:
                link_chars += len(part.strip())

    def close_to(k: int) -> None:
        leave(k)
        flush()
        stack.cut(k)

    def leave(k: int) -> None:
        """Closes what is embedded from k on, which is all at the end; the text around it goes on."""
        at = len(stack)
        while at > max(k, 1) and stack[at - 1].embedded:
            at -= 1
        stack.cut(at)

    def breaks(name: str) -> bool:
        """Whether a start tag ends what is embedded here: as browsers do in svg and math, and where an end tag is missing."""
        for e in reversed(stack):
            if not e.embedded or e.name in HOSTS:
                break
            if e.name in FOREIGN:
                return name in BREAKS
        return name in BLOCKS and stack.unclosed > 0

    while True:
        if raw_until:
            end = re.compile(rf"</{re.escape(raw_until)}(?=[\s/>])[^>]*>?", re.I).search(page, at)
            raw_until = None
            if not end:
                break
            at = end.end()
        m = _TOKEN.search(page, at)
        if not m:
            text(page[at:])
            break
        text(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            if m[0].startswith("<![CDATA["):
                text(m[0][9:].removesuffix("]]>"))
            continue
        name, closing, attributes = name.lower(), (m[1] or m[4]) == "/", m[3] or m[6] or ""
        if stack[-1].embedded:
            if closing:
                k = stack.last(name)
                if k and stack[k].embedded:
                    stack.cut(k)
                    continue
                if not k and (name not in INLINE or not stack.unclosed):
                    continue
                leave(0)
            elif name not in RAW and (breaks(name) or name in ("button", "select") and stack.names[name]):
                leave(0)
        if closing:
            if name in INLINE:
                links -= name == "a" and links > 0
                if dropped_inline and name == dropped_inline[-1]:
                    dropped_inline.pop()
                    inline_drop -= 1
            elif name == "br":
                flush()
            elif name in EMBEDDED and not stack.names[name]:
                continue
            elif name not in VOID:
                k = stack.last(name)
                close_to(k) if k else flush()
            if name not in INLINE:
                links = inline_drop = 0
                dropped_inline.clear()
            continue
        if name in RAW:
            raw_until = name
            continue
        if name in EMBEDDED or stack[-1].embedded:
            #: In svg and math only what can hold other elements matters.
            if name not in VOID and not attributes.rstrip().endswith("/") and (name in EMBEDDED or name in HOSTS or stack[-1].name not in FOREIGN):
                other = _EITHER[name].search(page, at) if name in EMBEDDED else None
                stack.push(name, True, False, "", True, name not in EMBEDDED or other is not None and other[0][1] == "/")
            continue
        if name in ("br", "hr"):
            flush()
            continue
        if name in VOID or name in ("html", "body"):
            continue
        if name in INLINE:
            if name == "a":
                links = 1
            if inline_drop or attributes and _is_furniture(name, attributes, stack[-1].inside)[0]:
                dropped_inline.append(name)
                inline_drop += 1
            continue
        flush()
        links = inline_drop = 0
        dropped_inline.clear()
        if name in CLOSES_P and stack.names["p"]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == "p":
                    close_to(k)
                    break
                if stack[k].name in SCOPES or stack[k].name in ("td", "th", "li", "blockquote"):
                    break
        if name in SIBLINGS:
            for k in range(len(stack) - 1, 0, -1) if any(stack.names[n] for n in SIBLINGS[name]) else ():
                if stack[k].name in SIBLINGS[name]:
                    close_to(k)
                    if name not in ("tr", "thead", "tbody", "tfoot"):
                        break
                elif stack[k].name in SCOPES:
                    break
        stack.push(name, *_is_furniture(name, attributes, stack[-1].inside))
    flush()
    return out


def _sums(found: list[Block]) -> dict[int, list[int]]:
    """Per path: characters, punctuation, linked characters and blocks."""
    sums: dict[int, list[int]] = {}
    for b in found:
        own = sums.setdefault(b.at.path, [0, 0, 0, 0])
        own[0] += b.chars
        own[1] += len(_PUNCT.findall(b.text))
        own[2] += b.links
        own[3] += 1
    return sums


def ratio(chars: int, punct: int, links: int, n: int) -> float:
    """A tag path's: its text per block, without links, raised by punctuation."""
    return log1p((chars - links) / n) * (1 + log1p(punct / n))


def path_scores(found: list[Block]) -> tuple[dict[int, float], float]:
    """The score of each path, its ratio smoothed over neighbouring blocks and fused with its own, and the threshold."""
    own = {p: ratio(*v) for p, v in _sums(found).items()}
    row = [own[b.at.path] for b in found]
    fused: dict[int, list[float]] = {}
    for k, b in enumerate(found):
        near = row[max(0, k - 1) : k + 2]
        fused.setdefault(b.at.path, []).append((2 * row[k] + sum(near) / len(near)) / 3)
    score = {p: sum(v) / len(v) for p, v in fused.items()}
    return score, 0.5 * sum(score[b.at.path] * b.chars for b in found) / sum(b.chars for b in found)


def _elements(found: list[Block]) -> list[Element]:
    """The elements that hold the blocks, each once, those above first."""
    seen: dict[int, Element] = {}
    for b in found:
        e = b.at
        while e is not None and e.number not in seen:
            seen[e.number] = e
            e = e.up
    return [seen[k] for k in sorted(seen)]


def _common(held: Counter[int], elements: list[Element]) -> Element:
    """The lowest element that holds all of what elements hold by their numbers."""
    total, within = sum(held.values()), Counter(held)
    for e in reversed(elements):
        if e.up is not None:
            within[e.up.number] += within[e.number]
    return next(e for e in reversed(elements) if within[e.number] == total)


def main_blocks(found: list[Block]) -> list[Block]:
    """The blocks of the content node, by tag-path ratios."""
    everything = [b for b in found if not b.at.drop]
    if not everything:
        return []
    some = [b for b in everything if not b.at.soft]
    #: Where most of the text is below such words, they say nothing.
    if 2 * sum(b.chars - b.links for b in some) < sum(b.chars - b.links for b in everything) or not some:
        some = everything
    score, threshold = path_scores(some)
    content = [b for b in some if score[b.at.path] >= threshold]
    elements = _elements(everything)
    #: What each element is in: the outermost article or main, the outermost main.
    root_of: dict[int, Element | None] = {}
    main_of: dict[int, Element | None] = {}
    for e in elements:
        up = e.up.number if e.up else None
        root_of[e.number] = root_of.get(up) or (e if e.name in ROOTS else None)
        main_of[e.number] = main_of.get(up) or (e if e.name == "main" else None)

    #: Of the roots that hold content the outermost; main, where it holds much of it, says itself what is main.
    total, mains, roots = sum(b.chars for b in content), Counter(), Counter()
    for b in content:
        for of, sums in ((root_of, roots), (main_of, mains)):
            if e := of[b.at.number]:
                sums[e.number] += b.chars
    roots = mains if mains.total() >= 0.3 * total else roots if roots.total() >= 0.3 * total else Counter()
    node = _common(roots or Counter(b.at.number for b in content), elements)
    while node.name in TEXT and node.up is not None:
        node = node.up
    over, in_node, in_article, in_own = set(), {}, {}, {}
    e = node
    while e is not None:
        over.add(e.number)
        e = e.up
    for e in elements:
        up = e.up.number if e.up else None
        in_node[e.number] = e is node or in_node.get(up, False)
        in_article[e.number] = e.name == "article" or in_article.get(up, False)

    #: In the node an element that may be furniture is, if its text is mostly links or its paths' ratio is low.
    if len(some) < len(everything):
        soft = {e.number: e for e in elements if e.soft is e}
        of = {n: [0, 0, 0, 0] for n in soft}
        for b in everything:
            if b.at.soft:
                for k, v in enumerate((b.chars, len(_PUNCT.findall(b.text)), b.links, 1)):
                    of[b.at.soft.number][k] += v
        for n in sorted(soft, reverse=True):  # those within count for those around them
            if (up := soft[n].up) is not None and up.soft:
                of[up.soft.number] = [x + y for x, y in zip(of[up.soft.number], of[n], strict=True)]
        passed: dict[int, bool] = {}
        for n in sorted(soft):
            up = soft[n].up
            chars, _, links, _ = of[n]
            passed[n] = links <= 0.3 * chars and ratio(*of[n]) >= threshold and (up is None or up.soft is None or passed[up.soft.number])
        some = [b for b in everything if not b.at.soft or passed[b.at.soft.number] and in_node[b.at.number]]

    chars, links = Counter(), Counter()
    for b in some:
        chars[b.at.path] += b.chars
        links[b.at.path] += b.links
    linked = {p for p, n in chars.items() if links[p] > 0.6 * n}
    inside = [in_node[b.at.number] for b in some]
    start, end = inside.index(True), len(inside) - 1 - inside[::-1].index(True)
    beside = lambda k: some[k].at.name in TEXT and some[k].at.up is not None and some[k].at.up.number in over
    level = lambda k: int(some[k].at.name[1]) if some[k].at.name in HEADINGS else 9
    first = start
    while first > 0 and beside(first - 1):
        first -= 1
    #: The headline stands before the body, with a byline or a lead between, unless the body has one as high.
    top = min((level(k) for k in range(first) if some[k].at.path not in linked), default=9)
    if top < min(level(k) for k in range(first, end + 1)):
        first = max(k for k in range(first) if level(k) == top and some[k].at.path not in linked)
    while end + 1 < len(some) and len(over) > 2 and beside(end + 1) and some[end + 1].at.up is node.up:
        end += 1
    #: Link lists go, but for those within an article or a main element without articles.
    has_article = any(i and in_article[b.at.number] for b, i in zip(some, inside, strict=True))
    own = lambda e: in_article[e.number] or not has_article and main_of[e.number] is not None
    return [b for k, b in enumerate(some) if first <= k <= end and (b.at.path not in linked or own(b.at))]


def main_text(page: str | None) -> str:
    return "\n".join(b.text for b in main_blocks(blocks(page or "")))


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [main_text(x.as_py()) for x in batch.column(2)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array([len(t) for t in texts], pa.int64())], ["page_id", "url", "text", "n_chars"])


def extracted(pages: DataFrame) -> DataFrame:
    """page_id, url, text, n_chars for each row of pages (page_id, url, html)."""
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"))
    return rows.mapInArrow(_extract, "page_id long, url string, text string, n_chars long")
