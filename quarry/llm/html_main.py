"""Main text of web pages by line-block distribution.

Markup is stripped into lines, one per block of the page. What a page element such as a menu, a page header, a footer,
a sidebar, a notice, an advert, a form, a script, a style or reader comments stands for is blanked into a run of empty
lines. Text length is then summed over sliding windows of ``WINDOW`` lines: a surge point is where the sum rises from
zero, a dive point where it falls back to zero; the lines between are one candidate stretch. Where ``article`` and ``main``
elements hold at least ``MOST`` of the text that is left, stretches that touch them are chosen; elsewhere they are cards of
other pages and blanked too, and the longest stretch is chosen with all that have at least ``SHARE`` of its text. All
stretches from the first chosen one to the last are kept whole (inside ``article`` or ``main``, where they are chosen), so a
short passage between two adverts stays.

Which blocks are furniture is said by element names and by words of class, id and role. A name that consists of such words
(and neutral ones, such as ``box``) always counts; one that only contains such a word (``with-sidebar``), and a form, counts
where it holds no more than half of the page's text. Inside ``article`` and ``main`` only whole names count, and headings
stay: there ``related-work`` and ``search-results`` are the author's own. Captions of figures stay.

Elements nest as HTML has it: an end tag that may be left out is implied (``p``, ``li``, table cells and so on), an element ends
with its parent, and furniture without an end tag of its own ends where an ``article`` or ``main`` begins in it.

The job is narrow: one pass over each page inside Arrow batches, no shuffle, and memory for one page at a time.

Defined results: null or empty html gives an empty text of 0 characters; unclosed elements end with their parent or the
page; end tags of elements that are not open are ignored; white space inside a block becomes one space; blocks are joined by an empty line; repeated
rows give repeated results and extra input columns pass through.
"""

from __future__ import annotations

import html
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

WINDOW = 3
SHARE, MOST = 0.2, 1 / 3

# Element names of HTML.
DROPPED = {"nav", "footer", "aside", "form", "menu", "dialog", "button", "select", "noscript", "template", "iframe", "object", "svg", "video", "audio", "canvas", "header", "fieldset", "label", "datalist", "head"}
RAW = ("script", "style", "textarea", "title", "xmp", "noframes")
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
INLINE = {"a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "label"}
MAIN = {"article", "main"}
#: Words of class, id and role values that mark page furniture.
FURNITURE = {"ad", "ads", "advert", "adverts", "advertisement", "advertising", "banner", "banners", "sponsor", "sponsored", "promo", "promotion", "cookie", "cookies", "consent", "gdpr", "notice", "notices", "popup", "modal", "overlay", "newsletter", "subscribe", "signup", "paywall", "menu", "menus", "nav", "navbar", "navigation", "breadcrumb", "breadcrumbs", "sidebar", "sidebars", "aside", "widget", "widgets", "related", "recommended", "share", "sharing", "social", "comment", "comments", "disqus", "reply", "replies", "respond", "footer", "header", "masthead", "toolbar", "pagination", "pager", "skip", "search", "login", "complementary", "contentinfo"}
#: Words that say nothing about what a block holds.
NEUTRAL = {"box", "container", "wrapper", "wrap", "block", "slot", "unit", "area", "section", "list", "bar", "side", "item", "inner", "outer", "top", "bottom", "left", "right", "inline", "content", "body", "main", "page", "site", "global", "primary", "secondary", "post", "article", "text", "links", "link", "buttons", "button", "form", "field", "widget"}
#: Elements dropped by name only where they hold no more than half of the page's text.
WEAK = {"form", "fieldset", "label"}
#: Elements that end an open one of these names, unless one of the last names is open inside it.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}), "option": ({"option"}, {"select", "datalist"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "tr": ({"tr"}, {"table"}), "tbody": ({"thead", "tbody", "tfoot"}, {"table"}), "tfoot": ({"thead", "tbody", "tfoot"}, {"table"}),
}
ENDS_P = {"address", "article", "aside", "blockquote", "details", "div", "dl", "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hgroup", "hr", "main", "menu", "nav", "ol", "p", "pre", "section", "table", "ul"}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}
TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<(?P<raw>" + "|".join(RAW) + r")\b(?:\"[^\"]*\"|'[^']*'|[^'\">])*>.*?(?:</(?P=raw)\s*>|\Z)"
    r"|<(?P<close>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:\"[^\"]*\"|'[^']*'|[^'\">])*)>|<[!?/][^>]*>|<[a-zA-Z/][^<]*\Z",
    re.S | re.I,
)
MARKED = re.compile(r"\b(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
SPACE = re.compile(r"\s+")


def _names(attrs: str) -> tuple[bool, bool]:
    """Whether class, id or role contain a furniture word, and whether one of their names consists of such and neutral words."""
    if "=" not in attrs:
        return False, False
    names = (n for a, b, c in MARKED.findall(attrs) for n in (a or b or c).lower().split())
    marked = [ws for ws in ([w for w in re.split(r"[^a-z]+", n) if w] for n in names) if any(w in FURNITURE for w in ws)]
    return bool(marked), any(all(w in FURNITURE or w in NEUTRAL for w in ws) for ws in marked)


@dataclass
class Element:
    name: str
    attrs: str
    start: int
    end: int = 0
    text: int = 0
    #: Whether its own end tag closed it, and the first event in it that opens an ``article`` or ``main``.
    own: bool = False
    main: int = 0


def events(page: str) -> list:
    """The page in order: texts, elements (where they open; ``end`` is the event after their last one) and None for a line break."""
    out: list = []
    stack: list[Element] = []
    #: Open elements by name, so that an element that is not open is not looked for.
    opened: Counter[str] = Counter()
    length = 0

    def close(depth: int, own: bool = False) -> None:
        while len(stack) > depth:
            e = stack.pop()
            opened[e.name] -= 1
            e.end, e.text, e.own = len(out), length - e.text, own and len(stack) == depth

    def open_at(names: set[str], limits: set[str]) -> int | None:
        for k in range(len(stack) - 1, -1, -1) if any(opened[n] for n in names) else ():
            if stack[k].name in names:
                return k
            if stack[k].name in limits:
                return None
        return None

    at = 0
    for m in TOKEN.finditer(page):
        if m.start() > at:
            out.append(page[at : m.start()])
            length += len(out[-1].replace(" ", "").strip())
        at = m.end()
        name = (m["name"] or "").lower()
        if not name:  # comment, declaration or raw text
            continue
        if m["close"]:
            k = open_at({name}, set() if name not in INLINE else {e.name for e in stack} - INLINE)
            if k is not None:
                close(k, own=True)
            continue
        names, limits = CLOSES.get(name, (set(), set()))
        k = open_at(names, limits) if names else open_at({"p"}, {"td", "th", "table", "caption", "button", "object"}) if name in ENDS_P else None
        if k is not None:
            close(k)
        if name == "br":
            out.append(None)
            continue
        if name in MAIN:
            for e in stack:
                e.main = e.main or len(out)
        e = Element(name, m["attrs"], len(out), text=length)
        out.append(e)
        if name in VOID or m["attrs"].endswith("/"):
            e.end, e.text, e.own = len(out), 0, True
        else:
            stack.append(e)
            opened[name] += 1
    if at < len(page):
        out.append(page[at:])
    close(0)
    return out


def block_lines(page: str) -> list[tuple[str, bool]]:
    """The page as lines (text, inside article or main); furniture leaves ``WINDOW`` empty lines."""
    found = events(page)
    total = sum(len(x.replace(" ", "").strip()) for x in found if isinstance(x, str))
    lines: list[tuple[str, bool]] = []
    here: list[str] = []
    ends: dict[int, list[bool]] = {}
    inside, k = 0, 0

    def end_block() -> None:
        text = SPACE.sub(" ", html.unescape("".join(here))).strip()
        here.clear()
        if text:
            lines.append((text, inside > 0))

    def furniture(e: Element) -> bool:
        if e.name in ("body", "html") or e.name in MAIN:
            return False
        most = 2 * e.text > total
        if e.name in DROPPED - INLINE and not (e.name == "header" and inside) and not (e.name in WEAK and most):
            return True
        some, whole = _names(e.attrs)
        if not some or (inside and e.name in HEADINGS):
            return False
        return whole if inside else whole or not most

    while k < len(found):
        for is_main in ends.pop(k, ()):
            end_block()
            inside -= is_main
        x = found[k]
        k += 1
        if x is None:
            here.append(" ")
        elif isinstance(x, str):
            here.append(x)
        elif x.name in VOID:
            if x.name not in INLINE:
                end_block()
        elif furniture(x):
            end_block()
            lines.extend([("", inside > 0)] * WINDOW)
            k = max(k, x.end if x.own or not x.main else x.main)
        elif x.name not in INLINE:
            end_block()
            inside += x.name in MAIN
            ends.setdefault(x.end, []).append(x.name in MAIN)
    # An element that ends with the page, or inside what was skipped, ends here.
    end_block()
    return lines


def _stretches(size: list[int]) -> list[tuple[int, int]]:
    """Runs of lines between a surge and a dive point of the window sums."""
    out: list[tuple[int, int]] = []
    start = None
    for i in range(len(size) + 1):
        window = sum(size[i : i + WINDOW])
        if start is None and window:
            start = i
        elif start is not None and not window:
            out.append((start, i))
            start = None
    return out


def main_text(page: str | None) -> str:
    """Text between the surge and dive points of the line-block distribution."""
    lines = block_lines(page or "")
    size = [len(t) for t, _ in lines]
    inside = sum(n for n, (_, own) in zip(size, lines) if own)
    within = inside > 0 and inside >= MOST * sum(size)
    if not within:
        size = [0 if own else n for n, (_, own) in zip(size, lines)]
        # Cards leave a gap, as furniture does.
        spread = [x for k, n in enumerate(size) for x in ([k] if n or not lines[k][1] else [None] * WINDOW)]
        size = [0 if k is None else size[k] for k in spread]
        lines = [("", False) if k is None else lines[k] for k in spread]
    stretches = _stretches(size)
    if within:
        chosen = [s for s in stretches if any(lines[k][1] and size[k] for k in range(*s))]
    else:
        longest = max((sum(size[a:b]) for a, b in stretches), default=0)
        chosen = [s for s in stretches if sum(size[slice(*s)]) >= SHARE * longest]
    kept = [k for k in range(chosen[0][0], chosen[-1][1]) if lines[k][1] or not within] if chosen else []
    return "\n\n".join(lines[k][0] for k in kept if size[k])


def extract(pages: DataFrame) -> DataFrame:
    """``pages`` with ``text`` and ``n_chars`` in place of ``html``; columns of those names in the input are replaced."""
    kept = [c for c in pages.columns if c not in ("html", "text", "n_chars")]
    slim = pages.select(*kept, "html")
    schema = T.StructType([*slim.select(*kept).schema.fields, T.StructField("text", T.StringType()), T.StructField("n_chars", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            html_at = b.schema.get_field_index("html")
            text = [main_text(x.as_py()) for x in b.column(html_at)]
            cols = [c for i, c in enumerate(b.columns) if i != html_at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(text, pa.string()), pa.array([len(t) for t in text], pa.int64())], names=[*kept, "text", "n_chars"])

    return slim.mapInArrow(run, schema)
