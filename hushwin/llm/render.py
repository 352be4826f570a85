"""Layout-aware HTML rendering to text.

A tokenizer and a tree builder turn markup into properly nested opening and
closing events, with implied tags supplied; a renderer walks the tree and
writes all visible text, with blank lines around paragraphs and headings,
list markers and indents, preformatted text as it stands, and table cells
aligned in columns. Formulas, the texts of drawings and the options of
selections are written too; a drawing's defs are not, even if used, and of
attributes only the labels of options. Every step is one pass without
recursion.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hushwin.llm.common import text_slices

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
#: Content is text up to the closing tag; none of it but textarea's is rendered.
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript template".split())
UNSEEN = frozenset("head script style title template noscript iframe noembed noframes datalist object audio video canvas".split())
#: Of a drawing; text stands in the third only. Of a formula's second, the first child is seen.
DRAWING_UNSEEN = frozenset("title desc metadata defs".split())
FIRST_SEEN = frozenset("semantics maction".split())
DRAWING_TEXT = frozenset("text foreignobject".split())
#: A drawing's or formula's elements that hold HTML again.
HOLDS_HTML = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
#: Opening one of these ends a drawing or formula.
ENDS_FOREIGN = frozenset("""b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta
nobr ol p pre ruby s small span strong strike sub sup table tt u ul var""".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr fieldset".split())
BLOCKS = PARAGRAPHS | frozenset("""html body div section article aside nav header footer main address details summary dialog figcaption form
legend li dt dd tr caption thead tbody tfoot center dir menu search hgroup option optgroup""".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: Opening one of these closes an open paragraph.
ENDS_P = BLOCKS - frozenset("html body tr caption thead tbody tfoot option optgroup legend".split()) | frozenset(["li", "dt", "dd"])
#: Opening the first closes an open element of the second, unless one of the third stands between.
IMPLIED = {
    "li": ("li", "ul ol menu dir"), "dt": ("dt dd", "dl"), "dd": ("dt dd", "dl"),
    "option": ("option", "select datalist optgroup"), "optgroup": ("option optgroup", "select"),
    "tr": ("tr td th caption", "table"), "td": ("td th", "tr table"), "th": ("td th", "tr table"),
    "thead": ("thead tbody tfoot tr td th caption", "table"), "tbody": ("thead tbody tfoot tr td th caption", "table"),
    "tfoot": ("thead tbody tfoot tr td th caption", "table"),
}
IMPLIED = {k: (frozenset(a.split()), frozenset(b.split()) | {"td", "th", "caption"} - frozenset(a.split())) for k, (a, b) in IMPLIED.items()}
#: No closing tag reaches out of these.
SCOPE = frozenset("table td th caption html".split())

_NAME = re.compile(r"[A-Za-z][^\x20\x09-\x0D/>]*")
_ATTRIBUTES = re.compile(r"""(?:[^>"']++|"[^"]*+"|'[^']*+')*+""")
_ATTRIBUTE = re.compile(r"""([^\x20\x09-\x0D/>][^\x20\x09-\x0D/>=]*+)(?:[\x20\x09-\x0D]*+=[\x20\x09-\x0D]*+(?:"([^"]*+)"|'([^']*+)'|([^\x20\x09-\x0D>]*+)))?""")
_MAY_HIDE = re.compile(r"hidden|style|display|visibility", re.I)
_CSS = re.compile(r"""/\*.*?(?:\*/|\Z)|"(?:[^"\\]|\\.)*+(?:"|\Z)|'(?:[^'\\]|\\.)*+(?:'|\Z)|url\((?![\x20\x09-\x0D]*+["'])[^)]*+\)?|\\.|[^"'/\\()\[\]{};u]++|.""", re.I | re.S)
_KEYWORDS = re.compile(r"([a-z-]+(?:[\x20\x09-\x0D]+[a-z-]+)*)[\x20\x09-\x0D]*(![\x20\x09-\x0D]*important)?")
_SPACE = re.compile(r"[\x20\x09-\x0D]+")
_CLOSE = {name: re.compile(rf"</{name}(?=[\x20\x09-\x0D/>])", re.I) for name in RAW}


def attributes(rest: str) -> dict[str, str]:
    """Lower-case names and decoded values; of a repeated name the first counts."""
    found: dict[str, str] = {}
    for m in _ATTRIBUTE.finditer(rest):
        value = m[m.lastindex] if m.lastindex > 1 else ""
        found.setdefault(m[1].lower(), html.unescape(value) if "&" in value else value)
    return found


def _in_value(rest: str) -> bool:
    """Whether the last character belongs to an attribute."""
    end = 0
    for m in _ATTRIBUTE.finditer(rest):
        end = m.end()
    return end == len(rest)


def _declarations(style: str) -> Iterator[str]:
    """The parts between semicolons, those in comments, strings and brackets aside."""
    part, depth = [], 0
    for m in _CSS.finditer(style):
        token = m[0]
        if token == ";" and not depth:
            yield "".join(part)
            part = []
            continue
        depth = max(0, depth + (token in ("(", "[", "{")) - (token in (")", "]", "}")))
        part.append(" " if token.startswith("/*") else token)
    yield "".join(part)


def visibility(rest: str, drawing: bool = False) -> tuple[bool, bool | None]:
    """(whether the element is out with all it holds, whether its own text is
    invisible or, if None, as visible as its parent's). As in a browser, a
    declared display counts more than the attribute ``hidden``, the last
    declaration counts, and an important one counts more. In a drawing the
    attributes display and visibility are declarations that count less."""
    found = attributes(rest)
    declared: dict[str, tuple] = {}
    given = [f"{name}:{found[name]}" for name in ("display", "visibility") if name in found] if drawing else []
    for part in [*given, *_declarations(found.get("style", ""))]:
        name, _, value = part.partition(":")
        name = name.strip().lower()
        if name in ("display", "visibility"):
            m = _KEYWORDS.fullmatch(value.strip().lower())
            if m and (m[2] or not declared.get(name, (None, None))[1]):
                declared[name] = m.groups()
    display, seen = (declared.get(name, ("revert", None))[0] for name in ("display", "visibility"))
    gone = found.get("hidden", "until-found").lower() != "until-found" if display in ("revert", "revert-layer") else display == "none"
    return gone, True if seen in ("hidden", "collapse") else False if seen in ("visible", "initial") else None


def scan(text: str, foreign=lambda: False) -> Iterator[tuple[str, str, str]]:
    """("text" | "open" | "close", name or text, attributes). ``foreign``
    says whether a drawing or formula is open: there all content is markup,
    CDATA is text and a closing slash counts."""
    at = 0
    while True:
        tag = text.find("<", at)
        if tag < 0:
            if at < len(text):
                yield "text", text[at:], ""
            return
        name = _NAME.match(text, tag + 1 + text.startswith("/", tag + 1))
        if not name and not text.startswith(("!", "?", "/"), tag + 1):
            yield "text", text[at:tag + 1], ""       # a lone <
            at = tag + 1
            continue
        if tag > at:
            yield "text", text[at:tag], ""
        if not name:                                  # comment, doctype, bogus markup
            mark, skip = ("-->", 3) if text.startswith("<!--", tag) else ("]]>", 3) if text.startswith("<![CDATA[", tag) else (">", 1)
            end = text.find(mark, tag + 2)
            if mark == "]]>" and foreign():
                yield "text", text[tag + 9:end if end >= 0 else len(text)].replace("&", "&amp;"), ""
            if end < 0:
                return
            at = end + skip
            continue
        end = _ATTRIBUTES.match(text, name.end()).end()
        if not text.startswith(">", end):             # a quote never closes
            end = text.find(">", name.end())
            if end < 0:
                return
        at = end + 1
        kind, low = ("close" if text[tag + 1] == "/" else "open"), name[0].lower()
        inside = foreign() and low not in ENDS_FOREIGN
        yield kind, low, text[name.end():end]
        if kind == "open" and (inside or low in ("svg", "math")):
            if text[end - 1] == "/" and low not in VOID and not _in_value(text[name.end():end]):
                yield "close", low, ""
        elif kind == "open" and low in RAW:
            close = _CLOSE[low].search(text, at)
            stop = close.start() if close else len(text)
            yield "text", text[at:stop], ""
            yield "close", low, ""
            if not close:
                return
            at = text.find(">", stop) + 1 or len(text)


def tree(text: str) -> Iterator[tuple[str, str, str]]:
    """``scan`` made a tree: every opening has its closing, in order."""
    stack: list[str] = []
    places: dict[str, list[int]] = {}       # where in the stack the open elements of a name are
    foreign = [False]               # for the root and each open element: whether it holds a drawing's or formula's elements

    def push(name):
        places.setdefault(name, []).append(len(stack))
        stack.append(name)
        foreign.append(name in ("svg", "math") or foreign[-1] and name not in HOLDS_HTML)

    def pop():
        name = stack.pop()
        foreign.pop()
        places[name].pop()
        return "close", name, ""

    def nearest(names) -> int:
        return max((at[-1] for n in names if (at := places.get(n))), default=-1)

    def depth_of(names, limit) -> int:
        """How many elements to close so that the nearest of ``names`` closes; 0 if a limit or the root comes first."""
        at = nearest(names)
        return len(stack) - at if at >= 0 and at >= nearest(limit) else 0

    for kind, name, rest in scan(text, lambda: foreign[-1]):
        if foreign[-1] and (name in ENDS_FOREIGN if kind == "open" else kind == "close" and name in ("p", "br")):
            while foreign[-1]:
                yield pop()
        if kind == "text":
            yield kind, name, rest
        elif kind == "open" and foreign[-1]:
            yield kind, name, rest
            if name in VOID:
                yield "close", name, ""
            else:
                push(name)
        elif kind == "open":
            if name in ENDS_P and places.get("p"):
                for _ in range(depth_of(("p",), SCOPE)):
                    yield pop()
            if name in HEADINGS and stack and stack[-1] in HEADINGS:
                yield pop()
            if name in IMPLIED:
                ends, limit = IMPLIED[name]
                while depth := depth_of(ends, limit):
                    for _ in range(depth):
                        yield pop()
            if name in ("td", "th") and places.get("table") and not depth_of(("tr",), frozenset(["table"])):
                push("tr")
                yield "open", "tr", ""
            yield kind, name, rest
            if name in VOID:
                yield "close", name, ""
            else:
                push(name)
        elif name == "br":
            yield "open", "br", ""
            yield "close", "br", ""
        elif name not in VOID:
            limit = frozenset() if name in ("table", "html", "body") else SCOPE - {name}
            if name in ("tr", "thead", "tbody", "tfoot", "td", "th", "caption"):
                limit = frozenset(["table"])
            for _ in range(depth_of(HEADINGS if name in HEADINGS else (name,), limit)):
                yield pop()
    while stack:
        yield pop()


#: Bounds of what is written besides the page's own text: levels of indent, characters of a cell that widens
#: its column, characters of a line that are padded, columns that spans are kept for.
MAX_INDENTS, MAX_CELL, MAX_PADDED, MAX_COLUMNS = 20, 60, 200, 50


class _Page:
    """Lines under construction: collapses white space, keeps block breaks."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False          # white space seen, not yet written
        self.blank = False          # a blank line is due before the next text
        self.prefix: list[str] = []
        self.marker = ""            # list marker due before the next text
        self.structured = False     # holds a preformatted text, or a list or table of several items or rows
        self.items = 0

    def text(self, s: str, pre: bool) -> None:
        if pre:
            for i, part in enumerate(s.replace("\r\n", "\n").replace("\r", "\n").split("\n")):
                if i:
                    self.end(keep=True)
                if part:
                    self._begin()
                    self.line.append(part)
            return
        parts = _SPACE.split(s)
        for i, word in enumerate(parts):
            self.space |= i > 0
            if word:
                if self.line:
                    self.line.append(" " if self.space else "")
                else:
                    self._begin()
                self.line.append(word)
                self.space = False

    def _begin(self) -> None:
        if self.line:
            return
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        indent = "".join(self.prefix[:MAX_INDENTS])
        if self.marker:
            indent = indent[:max(0, len(indent) - len(self.marker))] + self.marker
            self.marker = ""
        self.line.append(indent)

    def gap(self, pre: bool) -> None:
        """White space before more text on the line."""
        self.space = True
        if pre and self.line and not self.line[-1].endswith(" "):
            self.line.append(" ")

    def end(self, blank: bool = False, keep: bool = False) -> None:
        """Ends the line; ``blank`` asks for an empty line before more text, ``keep`` writes one at once."""
        if self.line:
            self.lines.append("".join(self.line).rstrip())
        elif keep and self.lines:
            self.lines.append("")
        self.line, self.space = [], False
        self.blank |= blank

    def done(self) -> list[str]:
        self.end()
        return self.lines


def _span(rest: str, name: str) -> int:
    value = attributes(rest).get(name, "") if name in rest.lower() else ""
    return min(int(value), 1000) if value.isascii() and value.isdigit() and int(value[:9]) > 0 else 1


class _Table:
    """Cells, each its lines, in the columns that spans leave them."""

    def __init__(self):
        self.rows: list[list[list[str]]] = []
        self.below: dict[int, int] = {}     # column: rows that a cell from above still covers

    def row(self) -> None:
        self.rows.append([])
        self.below = {c: n - 1 for c, n in self.below.items() if n > 1}

    def cell(self, lines: list[str], wide: int, high: int) -> None:
        row = self.rows[-1]
        while self.below.get(len(row), 0) and len(row) < MAX_COLUMNS:
            row.append([])
        at = len(row)
        row.append(lines)
        row += [[]] * (max(0, min(wide, MAX_COLUMNS - at) - 1))
        if high > 1:
            self.below |= {c: high for c in range(at, len(row)) if c < MAX_COLUMNS}

    def lines(self) -> list[str]:
        """Columns as wide as their widest cell, two spaces apart. A cell
        with a preformatted text, or a list or table of several items or
        rows, keeps its lines; other blocks in a cell run on. A cell beyond ``MAX_CELL``
        characters widens no column, and nothing is padded beyond
        ``MAX_PADDED`` characters of a line: a page's text grows in
        proportion to its markup."""
        rows = [r for r in self.rows if any(r)]
        wide: list[int] = []
        for row in rows:
            for i, cell in enumerate(row):
                if i == len(wide):
                    wide.append(0)
                if i < len(row) - 1:                # a row's last cell needs no padding
                    wide[i] = max([wide[i], *(n for x in cell if (n := len(x)) <= MAX_CELL)])
        out = []
        for row in rows:
            for k in range(max(map(len, row))):
                line = ""
                for i, cell in enumerate(row):
                    part = cell[k] if k < len(cell) else ""
                    if part or len(line) < MAX_PADDED:
                        line += ("  " if i else "") + (part.ljust(wide[i]) if len(line) + wide[i] <= MAX_PADDED else part)
                out.append(line.rstrip())
        return out


class _Foreign:
    """An open element from the outermost drawing or formula on."""

    def __init__(self, name: str, rest: str, parent: _Foreign | None):
        self.name, self.children = name, 0
        self.seen = name == "math" or name != "svg" and (name in DRAWING_TEXT or parent.seen)
        block = name == "math" and attributes(rest).get("display", "").lower() == "block"
        apart = name in ("text", "mtd") or name == "tspan" and "x" in attributes(rest) or parent and parent.name == "mfrac"
        #: What stands around it.
        self.around = "line" if block or name == "mtr" else "gap" if apart else ""


def render(markup: str | None) -> str:
    """The visible text of a page; empty for null or empty markup."""
    page, pages = _Page(), []
    hidden = pre = 0
    lists: list[list] = []          # [marker counter or None, ...]
    tables: list[_Table] = []
    spans: list[tuple[int, int]] = []
    unseen: list[str] = []          # open elements inside the outermost hidden one
    veils: list[bool] = []          # from the outermost invisible element on: whether the text of each open one is invisible
    foreign: list[_Foreign] = []

    def around(element: _Foreign) -> None:
        if element.around == "line":
            page.end()
        elif element.around:
            page.gap(bool(pre))

    for kind, name, rest in tree(markup or ""):
        if hidden:
            if kind == "open":
                unseen.append(name)
            elif kind == "close":
                unseen.pop()
                hidden = bool(unseen)
            continue
        if kind == "text":
            if not (veils and veils[-1] or foreign and not foreign[-1].seen):
                page.text(html.unescape(name) if "&" in name else name, bool(pre))
            continue
        if kind == "open":
            gone, veil = visibility(rest, name == "svg" or bool(foreign) and name != "math") if rest and _MAY_HIDE.search(rest) else (False, None)
            if foreign:
                foreign[-1].children += 1
                gone |= name in DRAWING_UNSEEN or foreign[-1].name in FIRST_SEEN and foreign[-1].children > 1
            if gone or name in UNSEEN:
                hidden, unseen = 1, [name]
                continue
            if name in ("option", "optgroup") and "label" in rest.lower() and (label := attributes(rest).get("label")):
                page.end()
                if not (veils and (veils[-1] if veil is None else veil) or veil):
                    page.text(label, False)
                    page.end()
                if name == "option":                  # shown instead of its content
                    hidden, unseen = 1, [name]
                    continue
            if foreign or name in ("svg", "math"):
                foreign.append(_Foreign(name, rest, foreign[-1] if foreign else None))
                around(foreign[-1])
                veil = True if name == "mphantom" and veil is None else veil
            if veils or veil:
                veils.append(veils[-1] if veil is None else veil)
            if name == "br":
                if not (veils and veils[-1]):
                    page.end(keep=True)
            elif name in ("td", "th") and tables and tables[-1].rows:
                spans.append((_span(rest, "colspan"), _span(rest, "rowspan")))
                pages.append((page, pre, lists))
                page, pre, lists = _Page(), 0, []
            else:
                if name in BLOCKS:
                    page.end(blank=name in PARAGRAPHS and not (name in ("ul", "ol") and lists))
                page.items += name == "li"
                page.structured |= page.items > 1 or name == "pre"
                if name in ("ul", "ol", "menu", "dir"):
                    start = re.search(r"start\s*=\s*[\"']?(-?[0-9]{1,9})", rest) if name == "ol" else None
                    lists.append([int(start[1]) if start else 1] if name == "ol" else [None])
                elif name == "li":
                    number = lists[-1][0] if lists else None
                    page.marker = "- " if number is None else f"{number}. "
                    if number is not None:
                        lists[-1][0] += 1
                    page.prefix.append(" " * len(page.marker))
                elif name in ("dd", "blockquote"):
                    page.prefix.append("  ")
                elif name == "pre":
                    pre += 1
                elif name == "table":
                    tables.append(_Table())
                elif name == "tr" and tables:
                    tables[-1].row()
                elif name == "img":
                    pass
            continue
        if veils:
            veils.pop()
        if foreign:
            around(foreign.pop())
        if name in ("td", "th") and tables and tables[-1].rows and pages:
            cell = [x for x in page.done() if x.strip()]
            if not page.structured:
                cell = [" ".join(x.strip() for x in cell)] if cell else []
            page, pre, lists = pages.pop()
            tables[-1].cell(cell, *spans.pop())
        elif name in BLOCKS:
            if name == "table" and tables:
                page.end()
                inner = tables.pop()
                page.structured |= len(inner.rows) > 1
                for line in inner.lines():
                    page._begin()
                    page.line.append(line)
                    page.end()
            page.end(blank=name in PARAGRAPHS and not (name in ("ul", "ol") and len(lists) > 1))
            if name in ("ul", "ol", "menu", "dir") and lists:
                lists.pop()
            elif name in ("li", "dd", "blockquote") and page.prefix:
                page.prefix.pop()
                page.marker = ""
            elif name == "pre":
                pre = max(0, pre - 1)
    while pages:
        page = pages.pop()[0]
    return "\n".join(page.done())


def extract(pages: DataFrame) -> DataFrame:
    """page_id and text for every row, repeated rows alike; no shuffle.

    A null or empty page has the text ''. However long, nested, wide or
    broken a page is, time and text grow in proportion to it: indents stop
    at ``MAX_INDENTS`` levels, padding and spans at the table's bounds."""
    def run(batches):
        for batch in text_slices(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([render(x) for x in batch.column(1).to_pylist()], pa.string())], names=["page_id", "text"])

    return pages.select(F.col("page_id").cast("long"), F.col("html").cast("string")).mapInArrow(run, "page_id long, text string")
