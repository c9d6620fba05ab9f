"""HTML to text by layout: a tree with implied tags, visibility rules, and a block renderer.

Blocks stand on lines of their own, paragraphs, headings, lists and tables with a blank
line around them; list items carry their mark and depth; cells of a table line up in
columns, with their own blocks and lists below each other, and spanning cells take the
places that they span; preformatted text keeps its spaces. Nothing that a reader sees is
dropped, and nothing hidden is kept: head, script, style, template, closed details,
``hidden`` and ``display: none``, and what inherits ``visibility: hidden`` and does not turn
it visible again.

A page is one row and is rendered on its own, so there is no shuffle and no skew beyond
the longest page, which is read and laid out in time linear in its length: what is open is
known by tag, and spanning cells are intervals of columns. A tag that the next ``<`` cuts
short is text. Null HTML gives null text, empty HTML empty text; broken markup is
closed where it must be; elements nested deeper than DEPTH are laid out as text of the
DEPTH-th (hidden ones still go), so that no page can exhaust the stack. A column of a table
is padded for cells of up to WIDE characters, and a table with a few times its text;
longer ones run over, so that output stays in proportion to the page. Of cells that would
overlap, the upper one keeps the column for the rows below. Of preformatted text the first
line break goes, all others stay. Repeated rows give repeated results; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

import html as entities
import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame

DEPTH = 200
#: Characters of a cell up to which its column is padded.
WIDE = 80
#: Spaces that a table is padded with at most: so many times its text, and so many besides; cells after them run over.
PADDING, PADDED = 4, 10_000
#: Most columns and rows that a cell may span, as browsers have it.
COLSPAN, ROWSPAN = 1000, 65534
TOKEN = re.compile(r"""<!--.*?(?:-->|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<tag>[a-zA-Z][^\s/<>]*+)(?P<attrs>(?:[^<>"']|"[^"<]*+(?:<[^"<]*+)*+"|'[^'<]*+(?:<[^'<]*+)*+')*+)>|[^<]+|<""", re.S)
NO_DISPLAY = re.compile(r"(?:^|;)\s*display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"(?:^|;)\s*visibility\s*:\s*(hidden|collapse|visible)", re.I)
ATTR = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""")

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset(("script", "style", "textarea", "title", "xmp", "iframe", "noembed", "noframes"))
HIDDEN = frozenset("head script style template title noscript iframe object audio video canvas datalist noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form header hgroup html legend li main menu nav optgroup option section summary tr caption".split())
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl pre table blockquote hr".split())
#: Opening one of these ends an open paragraph.
ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre section table ul li dd dt".split())
#: tag -> tags that its opening ends, and tags beyond which nothing is ended.
ENDS = {
    "li": (("li",), ("ul", "ol", "menu")), "dt": (("dt", "dd"), ("dl",)), "dd": (("dt", "dd"), ("dl",)), "option": (("option",), ("select",)), "optgroup": (("option", "optgroup"), ("select",)),
    "tr": (("tr", "td", "th"), ("table",)), "td": (("td", "th"), ("tr", "table")), "th": (("td", "th"), ("tr", "table")),
    "tbody": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "thead": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)), "tfoot": (("tbody", "thead", "tfoot", "tr", "td", "th", "caption"), ("table",)),
    "body": (("head",), ()),
}
SCOPE = frozenset(("table", "td", "th", "html", "body", "caption", "button", "template"))
#: Elements whose end tags no scope keeps out.
BEYOND = frozenset(("table", "body", "html", "tr", "tbody", "thead", "tfoot", "template"))


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: str = ""):
        self.tag, self.attrs, self.children = tag, attrs, []

    def get(self, name: str) -> str | None:
        for key, a, b, c in ATTR.findall(self.attrs) if self.attrs else ():
            if key.lower() == name:
                return a or b or c
        return None

    def style(self) -> str:
        return self.get("style") or "" if self.attrs and "style" in self.attrs.lower() else ""

    def hidden(self) -> bool:
        """Not laid out, with all that it holds."""
        if self.tag in HIDDEN:
            return True
        return bool(self.attrs) and (("hidden" in self.attrs.lower() and self.get("hidden") is not None) or NO_DISPLAY.search(self.style()) is not None)

    def shown(self, above: bool) -> bool:
        """Whether text is visible here, where it is ``above`` or not."""
        m = VISIBILITY.search(self.style())
        return m[1].lower() == "visible" if m else above


class Open:
    """The open elements, and for each tag the places where it is open, so that none is searched for.

    Those below DEPTH are no nodes of the tree, and only tell whether their text is hidden.
    """

    def __init__(self, root: Node):
        self.stack, self.places, self.hidden = [root], defaultdict(list), 0

    def push(self, node: Node) -> None:
        if len(self.stack) < DEPTH:
            self.stack[-1].children.append(node)
        else:
            self.hidden += node.hidden() or not node.shown(True)
        self.places[node.tag].append(len(self.stack))
        self.stack.append(node)

    def cut(self, at: int) -> None:
        """Closes all from place ``at`` on."""
        while len(self.stack) > at:
            node = self.stack.pop()
            self.places[node.tag].pop()
            if len(self.stack) >= DEPTH:
                self.hidden -= node.hidden() or not node.shown(True)

    def add(self, child: Node | str) -> None:
        if not self.hidden:
            self.stack[min(len(self.stack), DEPTH) - 1].children.append(child)

    def top(self, tags: tuple[str, ...] | frozenset) -> int:
        """The last place at which one of ``tags`` is open, 0 for none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def close(self, tags: tuple[str, ...], stops: tuple[str, ...] | frozenset) -> None:
        """Closes the open ones of ``tags`` that lie above every one of ``stops``."""
        while (at := self.top(tags)) > self.top(stops):
            self.cut(at)

    def end(self, tag: str) -> None:
        """An end tag: it closes its element unless a scope lies between."""
        at = self.top((tag,))
        if at and (tag in BEYOND or at >= self.top(SCOPE)):
            self.cut(at)


def parse(source: str) -> Node:
    """The tree of a page."""
    root = Node("html")
    open_, at = Open(root), 0
    while at < len(source):
        m = TOKEN.match(source, at)
        at = m.end()
        tag = m["tag"]
        if tag is None:
            if (text := m[0])[:2] not in ("<!", "<?"):
                open_.add(text)
            continue
        tag = tag.lower()
        if m["end"]:
            open_.end(tag)
            continue
        if tag == "html":
            root.attrs = root.attrs or m["attrs"]
            continue
        if tag in ENDS:
            open_.close(*ENDS[tag])
        if tag in ENDS_P:
            open_.close(("p",), SCOPE)
        if tag in ("td", "th") and open_.stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            open_.push(Node("tr"))  # the row that the markup leaves out
        node = Node(tag, m["attrs"])
        if tag in RAW:
            end = re.compile(rf"</{re.escape(tag)}\s*>", re.I).search(source, at)
            node.children.append(source[at : end.start() if end else len(source)])
            open_.add(node)
            at = end.end() if end else len(source)
        elif tag in VOID:  # a slash ends no other element
            open_.add(node)
        else:
            open_.push(node)
    return root


class Layout:
    """Lines under construction: pending breaks, indentation, and whether spaces count."""

    def __init__(self) -> None:
        self.out, self.breaks, self.space, self.indent, self.mark = [], 0, False, 0, ""

    def gap(self, lines: int) -> None:
        self.breaks, self.space = max(self.breaks, lines), False

    def newline(self) -> None:
        """A break that counts, after others."""
        self.breaks, self.space = self.breaks + 1, False

    def put(self, text: str) -> None:
        if self.breaks or not self.out:
            self.out.append(("\n" * self.breaks if self.out else "") + " " * max(0, self.indent - len(self.mark)) + self.mark)
            self.mark, self.breaks = "", 0
        elif self.space:
            self.out.append(" ")
        self.space = False
        self.out.append(text)

    def words(self, text: str) -> None:
        parts = entities.unescape(text).replace("\xa0", " ").split()
        if not parts:
            self.space = self.space or bool(text) and not self.breaks
            return
        self.space = self.space or text[0].isspace()
        self.put(" ".join(parts))
        self.space = text[-1].isspace()

    def text(self) -> str:
        return "".join(self.out)


def _span(cell: Node, name: str, most: int) -> int:
    n = cell.get(name) or "1"
    return max(1, min(int(n), most)) if n.isascii() and n.isdigit() and len(n) < 9 else 1


def _rows(node: Node, shown: bool) -> tuple[list[str], list[list[tuple[Node, bool]]]]:
    """Lines of a table that are in no cell, and its rows of cells."""
    loose, rows = [], []
    for c in node.children:
        if isinstance(c, str):
            if shown and c.strip():
                loose.append(" ".join(entities.unescape(c).split()))
        elif c.hidden():
            continue
        elif c.tag == "tr":
            inside = c.shown(shown)
            stray = Node("div")
            stray.children = [x for x in c.children if isinstance(x, str) or x.tag not in ("td", "th")]
            if line := " ".join(render(stray, inside).split()):
                loose.append(line)
            rows.append([(x, x.shown(inside)) for x in c.children if not isinstance(x, str) and x.tag in ("td", "th") and not x.hidden()])
        elif c.tag in ("tbody", "thead", "tfoot"):
            more = _rows(c, c.shown(shown))
            loose += more[0]
            rows += more[1]
        elif line := " ".join(render(c, shown).split()):
            loose.append(line)
    return loose, rows


class Free:
    """The columns that no spanning cell from above holds, as gaps in order; the last has no end."""

    def __init__(self) -> None:
        self.starts, self.ends, self.until = [0], [float("inf")], defaultdict(list)

    def row(self, number: int) -> None:
        """Lets go of what is held until this row."""
        for start, end in self.until.pop(number, ()):
            i = bisect_left(self.starts, start)
            if i and self.ends[i - 1] == start:
                i -= 1
                start = self.starts[i]
                del self.starts[i], self.ends[i]
            if i < len(self.starts) and self.starts[i] == end:
                end = self.ends[i]
                del self.starts[i], self.ends[i]
            self.starts.insert(i, start)
            self.ends.insert(i, end)

    def first(self, at: int) -> int:
        """The first free column from ``at`` on."""
        i = bisect_right(self.starts, at) - 1
        return at if i >= 0 and self.ends[i] > at else self.starts[i + 1]

    def take(self, start: int, end: int, until: int) -> None:
        """Holds the free ones of these columns until row ``until``; what another cell holds stays with it."""
        i = max(0, bisect_right(self.starts, start) - 1)
        while i < len(self.starts) and self.starts[i] < end:
            low, high = self.starts[i], self.ends[i]
            if high <= start:
                i += 1
                continue
            self.until[until].append((max(low, start), min(high, end)))
            parts = [(a, b) for a, b in ((low, start), (end, high)) if a < b]
            self.starts[i : i + 1], self.ends[i : i + 1] = [a for a, _ in parts], [b for _, b in parts]
            i += len(parts)


def _table(node: Node, shown: bool) -> str:
    """Rows of a table with its cells in aligned columns."""
    loose, rows = _rows(node, shown)
    placed: list[list[tuple[int, int, list[str]]]] = []  # per row: column, columns, lines of each cell
    free, widths, size = Free(), {}, 0
    for number, row in enumerate(rows):
        free.row(number)
        at, cells = 0, []
        for cell, visible in row:
            at = free.first(at)
            across, down = _span(cell, "colspan", COLSPAN), _span(cell, "rowspan", ROWSPAN)
            lines = [line.rstrip() for line in render(cell, visible).split("\n")]
            size += sum(map(len, lines))
            cells.append((at, across, lines))
            if across == 1 and (fit := [len(x) for x in lines if len(x) <= WIDE]):
                widths[at] = max(widths.get(at, 0), *fit)
            if down > 1:
                free.take(at, at + across, min(number + down, len(rows)))
            at += across
        placed.append(cells)
    columns = sorted(widths)
    starts = list(accumulate((widths[c] + 2 if widths[c] else 0 for c in columns), initial=0))
    out, spaces = loose, PADDING * size + PADDED
    for cells in placed:
        last = max((i for _, _, lines in cells for i, x in enumerate(lines) if x), default=-1)
        for i in range(last + 1):
            line = []
            length = after = 0
            for at, _, lines in cells:
                if text := lines[i] if i < len(lines) else "":
                    if (k := bisect_left(columns, at)) < len(columns):
                        after = starts[k]
                    least = length + 2 if length else 0
                    pad = max(after, least) - length if spaces > 0 else least - length
                    spaces -= pad
                    line += " " * pad, text
                    length += pad + len(text)
            out.append("".join(line))
    return "\n".join(out)


def render(root: Node, shown: bool = True) -> str:
    """Text of an element, whose surroundings are visible or not."""
    out = Layout()

    def lines(text: str) -> None:
        for line in text.split("\n"):
            out.put(line)
            out.gap(1)

    def visit(n: Node, pre: bool, shown: bool) -> None:
        tag = n.tag
        if n.hidden():
            return
        shown = n.shown(shown)
        if tag == "br":
            out.gap(min(2, out.breaks + 1))
            return
        if tag == "img":
            if shown and (alt := n.get("alt")):
                out.words(f" {alt} ")
            return
        if tag == "table":
            out.gap(2)
            if body := _table(n, shown):
                lines(body)
            out.gap(2)
            return
        block = 2 if tag in SPACED else 1 if tag in BLOCK else 0
        nested = tag in ("ul", "ol") and out.indent > 0
        if block:
            out.gap(1 if nested else block)
        step = 2 if tag in ("ul", "ol", "menu", "dd", "blockquote") else 0
        out.indent += step
        start = n.get("start") or "1"
        number = int(start) if tag == "ol" and start.isascii() and start.isdigit() else 1
        closed = tag == "details" and n.get("open") is None
        for k, c in enumerate(n.children):
            if isinstance(c, str):
                if not shown:
                    continue
                if pre or tag == "pre":
                    text = entities.unescape(c).replace("\r\n", "\n")
                    for i, line in enumerate((text.removeprefix("\n") if tag == "pre" and not k else text).split("\n")):
                        if i:
                            out.newline()
                        if line.strip() or line and i == 0 and out.out and not out.breaks:
                            out.put(line)
                elif not closed:
                    out.words(c)
            elif not closed or c.tag == "summary":
                if c.tag == "li" and not c.hidden():
                    out.gap(1)
                    out.mark = f"{number}. " if tag == "ol" else "- "
                    number += 1
                    visit(c, pre, shown)
                    out.mark = ""
                else:
                    visit(c, pre or tag == "pre", shown)
        out.indent -= step
        if block:
            out.gap(1 if nested else block)

    visit(root, False, shown)
    return out.text()


def to_text(source: str | None) -> str | None:
    return None if source is None else render(parse(source))


def extract(pages: DataFrame, key: str = "page_id", html: str = "html") -> DataFrame:
    """key and text of every page."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = pa.array([to_text(x.as_py()) for x in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts], names=["key", "text"])

    kind = pages.schema[key].dataType.simpleString()
    rows = pages.select(pages[key].alias("key"), pages[html].cast("string").alias("html"))
    return rows.mapInArrow(run, f"key {kind}, text string").withColumnRenamed("key", key)
