"""Layout-aware text of web pages.

A page is built into a tree as browsers do: tags that a page leaves out are implied (a
block closes a paragraph, an item the item before, a cell its row), stray end tags are
ignored, and raw text elements are read to their end. Visibility rules then decide
what is seen: no scripts, styles, head or templates, nothing ``hidden`` or styled
``display:none``; ``visibility`` is inherited and may be taken back; a closed
``details`` shows its summary.

All visible text is written, in order. White space collapses as in a browser, except
in ``pre`` and ``textarea``. Blocks stand on lines of their own, paragraphs and
headings apart by an empty line; list items have a marker and hang under it;
quotations a ``>``. The cells of a table are laid out in columns of equal width
(a column wider than ``WIDEST`` characters does not pad the others; spanning cells
take the columns they span, up to the limits of HTML), and keep their empty lines.
Text that stands in a table but in no cell comes before it, as browsers move it there.

Time and output are linear in the page however it nests: both passes use explicit
stacks, the nearest open element of a kind is known without a search, and layout ends
where no reader would follow it. Lists and quotations hang no further than ``DEEPEST``
levels, columns that would begin beyond ``FARTHEST`` characters are not aligned, and
tables inside more than ``TABLES`` others are written cell after cell. No word is lost.

Defined results: a null or empty page has an empty text, an empty table no rows. Rows
that repeat an id are rendered each; other columns, whatever their names, are not read.
A page is rendered whole in memory (about 20 times its size at worst).
"""

from __future__ import annotations

import html
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

from gleaner.llm.storage import prepared

WIDEST = 60
DEEPEST = 64
FARTHEST = 2000
TABLES = 16

# Fixed values of the HTML language.
MOST_COLUMNS = 1000
MOST_ROWS = 65534
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title iframe noembed noframes xmp".split())
HEAD_ONLY = frozenset("title meta link style script base noscript template".split())
HIDDEN = frozenset(
    "head title script style template noscript iframe noembed noframes object audio video canvas datalist area param rp".split()
)
BLOCKS = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary "
    "table ul caption xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl pre blockquote table figure hr fieldset xmp".split())
CLOSES_P = BLOCKS - frozenset("option optgroup caption legend body html".split())
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())

_START_TAG = re.compile(r"<([a-zA-Z][^\s/>]*)((?:=\s*\"[^\"]*\"|=\s*'[^']*'|[^>])*+)>")
_END_TAG = re.compile(r"</([a-zA-Z][^\s/>]*)[^>]*>")
_ATTRIBUTE = re.compile(r"([^\s=/>\"']+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>\"']+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_DISPLAY_NONE = re.compile(r"(?:^|;)\s*display\s*:\s*none\b")
_VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(\w+)")
_COUNT = re.compile(r"[ \t\n\r\f]*\+?0*([0-9]+)")
_LONG_REFERENCE = re.compile(r"&#(?=[0-9]{4000})0*([0-9]{0,8})[0-9]*")


def unescape(data: str) -> str:
    """Character references resolved; a number of thousands of digits is one outside Unicode like any other."""
    if len(data) > 4000 and "&#" in data:
        data = _LONG_REFERENCE.sub(lambda m: "&#" + (m[1] or "0"), data)
    return html.unescape(data)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


def attributes(source: str) -> dict[str, str]:
    """Attributes by lower-case name; of repeated ones the first."""
    out: dict[str, str] = {}
    for name, double, single, bare in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), unescape(double or single or bare))
    return out


#: A start tag closes the nearest open element of the first set, unless one of the second is nearer.
_IMPLIED = (
    {"li": (frozenset({"li"}), frozenset("ul ol menu".split()))}
    | dict.fromkeys(("dt", "dd"), (frozenset("dt dd".split()), frozenset({"dl"})))
    | dict.fromkeys(("option", "optgroup"), (frozenset({"option"}), frozenset({"select"})))
    | dict.fromkeys(("rt", "rp"), (frozenset("rt rp".split()), frozenset({"ruby"})))
    | dict.fromkeys(CELLS, (CELLS, frozenset("tr table".split())))
    | {"tr": (frozenset({"tr"}), frozenset({"table"}))}
)
_SCOPE = frozenset("td th caption table html".split())
_OF_TABLE = SECTIONS | {"caption", "colgroup"}
_TABLE, _ROW = frozenset({"table"}), frozenset({"tr"})


class Builder:
    """A tree from a page's source."""

    def __init__(self):
        self.root = Node("html")
        self.open = [self.root]
        self.depths: defaultdict[str, list[int]] = defaultdict(list)  # of the open elements of a tag

    def push(self, node: Node) -> None:
        self.open[-1].children.append(node)
        self.depths[node.tag].append(len(self.open))
        self.open.append(node)

    def pop(self) -> None:
        self.depths[self.open.pop().tag].pop()

    def nearest(self, tags: frozenset[str]) -> int:
        """Depth of the innermost open element of these tags; 0 if there is none."""
        return max((self.depths[tag][-1] for tag in tags if self.depths.get(tag)), default=0)

    def close(self, tags: frozenset[str], barrier: frozenset[str]) -> bool:
        """Close the nearest open element of these tags; not past a barrier."""
        depth = self.nearest(tags)
        if not depth or depth < self.nearest(barrier):
            return False
        while len(self.open) > depth:
            self.pop()
        return True

    def start(self, tag: str, attrs: dict[str, str], empty: bool) -> None:
        if tag in ("html", "body"):
            self.close(frozenset({"head"}), _SCOPE)
            if tag == "body" and not self.depths.get("body"):
                self.push(Node("body", attrs))
            return
        if self.depths.get("head") and tag not in HEAD_ONLY and self.open[-1].tag == "head":
            self.pop()
        if tag in CLOSES_P:
            self.close(frozenset({"p"}), _SCOPE | {"button"})
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self.pop()
        if tag in _IMPLIED:
            self.close(*_IMPLIED[tag])
        if tag in _OF_TABLE and self.nearest(_TABLE):
            while self.open[-1].tag != "table":
                self.pop()
        if tag in CELLS and self.nearest(_TABLE) and self.nearest(_ROW) < self.nearest(_TABLE):
            self.push(Node("tr"))
        node = Node(tag, attrs)
        if tag in VOID or (empty and tag in ("svg", "path")):
            self.open[-1].children.append(node)
        else:
            self.push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br"))
        elif tag in ("body", "html"):
            return
        elif tag in HEADINGS:
            self.close(HEADINGS, _SCOPE)
        else:
            barrier = frozenset({"table"}) if tag in SECTIONS | CELLS | {"table", "tr", "caption"} else _SCOPE
            if not self.close(frozenset({tag}), barrier - {tag}) and tag == "p":
                self.open[-1].children.append(Node("p"))

    def text(self, data: str) -> None:
        if self.open[-1].tag == "head" and data.strip():
            self.pop()
        self.open[-1].children.append(data)


def parse(source: str) -> Node:
    """The tree of a page. A tag or comment that the source does not end takes the rest with it."""
    builder, at, begin = Builder(), 0, 0
    while True:
        less = source.find("<", at)
        follows = source[less + 1 : less + 2] if less >= 0 else ""
        if less >= 0 and not (follows in "!?/" or (follows.isascii() and follows.isalpha())) or less >= 0 and not follows:
            at = less + 1  # a sign like any other
            continue
        text = source[begin : less if less >= 0 else len(source)]
        if text:
            builder.text(unescape(text))
        if less < 0:
            return builder.root
        if source.startswith("<!--", less):
            stop = source.find("-->", less + 4)
            stop = stop + 3 if stop >= 0 else -1
        elif follows in "!?" or not source[less + 2 : less + 3].isalpha() and follows == "/":
            stop = source.find(">", less) + 1 or -1
        else:
            match = (_END_TAG if follows == "/" else _START_TAG).match(source, less)
            stop = match.end() if match else -1
            if match and follows == "/":
                builder.end(match[1].lower())
            elif match:
                tag = match[1].lower()
                builder.start(tag, attributes(match[2]) if match[2] else {}, match[2].rstrip().endswith("/"))
                if tag in RAW:
                    end = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.I).search(source, stop)
                    raw = source[stop : end.start() if end else len(source)]
                    if raw:
                        builder.open[-1].children.append(unescape(raw) if tag in ("textarea", "title") else raw)
                    stop = end.start() if end else -1
        if stop < 0:
            return builder.root
        at = begin = stop


class Sink:
    """Lines of text as they come: collapsed white space, gaps between blocks, prefixes of lists and quotations."""

    def __init__(self):
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = 0
        self.markers: list[str] = []  # what leads the first line of each open item or quotation
        self.leads = [""]  # what leads the further lines of the first 0, 1, 2, ... of them
        self.used = 0  # how many have their first line

    def hang(self, marker: str, rest: str) -> None:
        self.leads.append(self.leads[-1] + rest if len(self.markers) < DEEPEST else self.leads[-1])
        self.markers.append(marker)

    def unhang(self) -> None:
        self.markers.pop()
        self.leads.pop()
        self.used = min(self.used, len(self.markers))

    def words(self, data: str) -> None:
        if not data:
            return
        text = _SPACE.sub(" ", data)
        if text[0] == " ":
            self.space = True
            text = text[1:]
        if not text:
            return
        tail = text[-1] == " "
        if self.space and self.parts:
            self.parts.append(" ")
        self.parts.append(text[:-1] if tail else text)
        self.space = tail

    def verbatim(self, data: str) -> None:
        rows = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, row in enumerate(rows):
            if k:
                self.line(forced=True)
            if row:
                self.parts.append(row)

    def line(self, forced: bool = False) -> None:
        """End the line. forced: also if nothing stands on it."""
        text = "".join(self.parts).rstrip()
        self.parts, self.space = [], False
        if not text and not forced:
            return
        if self.lines and self.gap:
            self.lines += [self.leads[self.used].rstrip()] * self.gap
        self.gap = 0
        lead = self.leads[self.used] + "".join(self.markers[self.used :])
        self.used = len(self.markers)
        self.lines.append((lead + text).rstrip())

    def block(self, gap: int = 0) -> None:
        self.line()
        self.gap = max(self.gap, gap)

    def result(self) -> list[str]:
        self.line()
        lines = self.lines
        while lines and not lines[-1].strip():
            lines.pop()
        blank = 0
        while blank < len(lines) and not lines[blank].strip():
            blank += 1
        return lines[blank:]


class Table:
    """Cells by row and column; a cell keeps the columns and rows that it spans, to the end of its row group."""

    def __init__(self):
        self.rows: list[list[tuple[int, int, list[str]]]] = []
        self.section()

    def section(self) -> None:
        """A row group begins or ends: no cell spans beyond it."""
        self.begins: list[float] = [0]  # the free columns, as ranges; the last one has no end
        self.ends = [float("inf")]
        self.freed: dict[int, list[tuple[int, float]]] = {}  # ranges by the row that has them again
        self.at = 0

    def row(self) -> None:
        self.rows.append([])
        self.at = 0
        for begin, end in self.freed.pop(len(self.rows) - 1, ()):
            k = bisect_left(self.begins, begin)
            if self.begins[k] == end:
                self.begins[k] = begin
            else:
                self.begins.insert(k, begin)
                self.ends.insert(k, end)
            if k and self.ends[k - 1] == begin:
                self.ends[k - 1] = self.ends[k]
                del self.begins[k], self.ends[k]

    def cell(self, lines: list[str], span: int, rows: int) -> None:
        if not self.rows:
            self.row()
        k = bisect_right(self.ends, self.at)
        column = max(self.at, self.begins[k])
        self.at = column + span
        self.rows[-1].append((column, span, lines))
        if rows != 1:
            self._take(k, column, column + span, len(self.rows) - 1 + rows if rows else None)

    def _take(self, k: int, begin: int, end: int, until: int | None) -> None:
        """Columns that are not free before this row; None: before the group ends."""
        stop = bisect_left(self.begins, end)
        ranges = list(zip(self.begins[k:stop], self.ends[k:stop], strict=True))
        left = [(b, e) for lo, hi in ranges for b, e in ((lo, min(hi, begin)), (max(lo, end), hi)) if b < e]
        self.begins[k:stop], self.ends[k:stop] = [b for b, _ in left], [e for _, e in left]
        if until is not None:
            taken = [(max(lo, begin), min(hi, end)) for lo, hi in ranges]
            self.freed.setdefault(until, []).extend(taken)

    def layout(self) -> list[str]:
        """Lines of the table. Columns in which no cell begins have no width."""
        columns = sorted({column for row in self.rows for column, _, _ in row})
        place = {column: k for k, column in enumerate(columns)}
        widths = [0] * len(columns)
        for row in self.rows:
            for column, span, lines in row:
                k = place[column]
                if k + 1 == len(columns) or columns[k + 1] >= column + span:
                    longest = max(map(len, lines), default=0)
                    widths[k] = max(widths[k], longest if longest <= WIDEST else 0)
        begins = list(accumulate((width + 2 for width in widths), initial=0))
        out: list[str] = []
        for row in self.rows:
            live = [(at, min(begins[place[column]], FARTHEST), lines) for at, (column, _, lines) in enumerate(row) if lines]
            k = 0
            while live:
                parts, length = [], 0
                for at, begin, lines in live:
                    if lines[k]:
                        pad = max(begin - length, 2 if at else 0)
                        parts += [" " * pad, lines[k]]
                        length += pad + len(lines[k])
                out.append("".join(parts).rstrip())
                k += 1
                live = [cell for cell in live if len(cell[2]) > k]
        return out


def _span(value: str | None, least: int, most: int) -> int:
    """A number of columns or rows as HTML reads it; 1 if there is none."""
    found = _COUNT.match(value or "")
    number = (int(found[1]) if len(found[1]) < 7 else most) if found else 1
    return min(number, most) if number >= least else 1


class Renderer:
    def __init__(self):
        self.sinks = [Sink()]
        self.tables: list[Table | None] = []  # None: too deep for columns
        self.lists: list[list] = []
        self.verbatim = 0

    def enter(self, node: Node) -> None:
        tag, sink = node.tag, self.sinks[-1]
        if tag == "br":
            sink.line(forced=True)
        elif tag == "hr":
            sink.block(1)
            sink.words("---")
            sink.block(1)
        elif tag == "input":
            if node.attrs.get("type", "").lower() in ("submit", "button", "reset"):
                sink.words(f" {node.attrs.get('value', '')} ")
        elif tag == "table":
            sink.block(1)
            self.tables.append(Table() if len(self.tables) < TABLES else None)
        elif tag in CELLS and self.tables:
            if self.tables[-1]:
                self.sinks.append(Sink())
            else:
                sink.block()
        elif tag == "tr" and self.tables and self.tables[-1]:
            self.tables[-1].row()
        elif tag in SECTIONS and self.tables and self.tables[-1]:
            self.tables[-1].section()
        elif tag in BLOCKS:
            sink.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and self.lists) else 0)
            if tag in ("ul", "ol", "menu"):
                first = node.attrs.get("start", "1")
                self.lists.append([int(first) if re.fullmatch(r"-?\d{1,9}", first) else 1] if tag == "ol" else [None])
            elif tag == "li":
                own = self.lists[-1] if self.lists else [None]
                marker = "- " if own[0] is None else f"{own[0]}. "
                own[0] = None if own[0] is None else own[0] + 1
                sink.hang(marker, " " * len(marker))
            elif tag == "dd":
                sink.hang("  ", "  ")
            elif tag == "blockquote":
                sink.hang("> ", "> ")
        if tag in ("pre", "textarea", "xmp"):
            self.verbatim += 1

    def leave(self, node: Node) -> None:
        tag, sink = node.tag, self.sinks[-1]
        if tag in ("pre", "textarea", "xmp"):
            self.verbatim -= 1
        if tag == "table":
            table = self.tables.pop()
            sink.line()
            for line in table.layout() if table else ():
                sink.parts.append(line)
                sink.line(forced=True)
            sink.block(1)
        elif tag in CELLS and self.tables:
            if self.tables[-1]:
                lines = self.sinks.pop().result()
                spans = _span(node.attrs.get("colspan"), 1, MOST_COLUMNS), _span(node.attrs.get("rowspan"), 0, MOST_ROWS)
                self.tables[-1].cell(lines, *spans)
            else:
                sink.block()
        elif tag in SECTIONS and self.tables and self.tables[-1]:
            self.tables[-1].section()
        elif tag in BLOCKS and tag != "hr":
            sink.block(1 if tag in SPACED and not (tag in ("ul", "ol", "menu") and len(self.lists) > 1) else 0)
            if tag in ("ul", "ol", "menu"):
                self.lists.pop()
            elif tag in ("li", "dd", "blockquote"):
                sink.unhang()

    def text(self, data: str) -> None:
        if self.verbatim:
            self.sinks[-1].verbatim(data)
        else:
            self.sinks[-1].words(data)


def _shown(node: Node, parent_visible: bool) -> tuple[bool, bool]:
    """Is the element laid out at all, and is its own text visible?"""
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False, False
    style = node.attrs.get("style", "").lower()
    if style and _DISPLAY_NONE.search(style):
        return False, False
    found = _VISIBILITY.search(style) if style else None
    return True, (found[1] not in ("hidden", "collapse") if found else parent_visible)


def render(source: str | None) -> str:
    """The visible text of a page, laid out."""
    if not source:
        return ""
    renderer = Renderer()
    # What is still to do: a node to enter with its parent's visibility, or one to leave.
    todo: list[tuple[Node | str, bool, bool]] = [(parse(source), True, True)]
    while todo:
        item, entering, visible = todo.pop()
        if isinstance(item, str):
            if visible:
                renderer.text(item)
            continue
        if not entering:
            renderer.leave(item)
            continue
        laid_out, visible = _shown(item, visible)
        if not laid_out:
            continue
        renderer.enter(item)
        todo.append((item, False, visible))
        children = item.children
        if item.tag == "details" and "open" not in item.attrs:
            summary = [c for c in children if isinstance(c, Node) and c.tag == "summary"]
            children = summary[:1]
        todo += [(child, True, visible) for child in reversed(children)]
    return "\n".join(renderer.sinks[0].result())


def extracted(pages: DataFrame) -> DataFrame:
    """(page_id, text) of every row of ``pages`` (page_id, html)."""
    prepared(pages.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [render(source.as_py()) for source in batch["html"]]
            yield pa.RecordBatch.from_arrays([batch["page_id"], pa.array(texts, pa.string())], names=["page_id", "text"])

    return pages.select("page_id", "html").mapInArrow(scan, "page_id long, text string")
