"""Visible text of web pages, laid out as a browser without style sheets would.

Each page goes through a tokenizer, a tree builder and a renderer. The builder supplies what HTML
lets authors omit: end tags of paragraphs, items, cells and rows, and what a stray end tag means.
The renderer leaves out what isn't shown, folds white space outside preformatted text, keeps blocks
apart, writes markers and indents of lists, and aligns the cells of a table in columns.

Pages are independent rows: a scan and a projection, whatever the table's size. A page takes time
and memory in proportion to its length.

Defined results: NULL gives NULL, an empty page an empty text. Broken markup is never an error. As
in browsers, elements nested deeper than ``DEEPEST`` become siblings. Further columns are kept.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tagloom.llm.tables import whole_texts

DEEPEST = 200
# Cells wider than this aren't padded, so that one long cell doesn't widen every row.
WIDEST_COLUMN = 60
# Columns that start beyond this aren't aligned: their cells follow the ones before.
WIDEST_LINE = 1000

# Classes of elements.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes textarea title plaintext".split())
NOT_SHOWN = frozenset(
    "head script style template title meta link base noembed noframes iframe datalist param "
    "source track object audio video canvas area col colgroup".split()
)
# Blocks that browsers set apart by a margin, and other blocks.
APART = frozenset(
    "p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir table pre listing xmp plaintext hr figure "
    "fieldset".split()
)
BLOCKS = APART | frozenset(
    "html body address article aside center details dialog dd div dt figcaption footer form header "
    "hgroup legend li main nav optgroup option search section summary caption thead tbody tfoot tr "
    "td th".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
LISTS = frozenset("ul ol menu dir".split())
SECTIONS = frozenset("thead tbody tfoot".split())
CELLS = frozenset("td th".split())
# What may stand in a head; anything else ends it.
IN_HEAD = frozenset("base basefont bgsound head link meta noframes script style template title".split())
# Parts of a table's structure, and the open element that each part is put into.
STRUCTURE = SECTIONS | {"table", "tr"}
PART_OF = (
    {"tr": SECTIONS | {"table"}, "td": {"tr"}, "th": {"tr"}}
    | {t: {"table"} for t in (*sorted(SECTIONS), "caption", "colgroup", "col")}
)
# Elements that stay where they are within a table; others are moved before it.
IN_TABLE = frozenset("script style template form".split())
# Not shown within pictures and formulas.
NOT_DRAWN = {
    "svg": frozenset("desc metadata defs symbol clippath mask pattern marker filter".split()),
    "math": frozenset("annotation annotation-xml".split()),
}
# A start tag ends these open elements, if one of them lies above the nearest barrier.
ENDS = (
    {"li": ({"li"}, LISTS), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"})}
    | {"tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"})}
    | {c: ({"td", "th"}, {"tr", "table"}) for c in CELLS}
    | {s: (SECTIONS | {"tr", "td", "th", "caption", "colgroup"}, {"table"}) for s in SECTIONS}
    | {"option": ({"option"}, {"select", "optgroup", "datalist"})}
    | {"optgroup": ({"option", "optgroup"}, {"select"})}
    | {"body": ({"head"}, set())}
)
# What a stray end tag, or the end of a paragraph, doesn't reach beyond.
BARRIERS = CELLS | {"table", "caption", "button", "template", "object"}

_TOKEN = re.compile(
    r"""<!--(?:>|->|.*?(?:--!?>|\Z))|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*>?|</(?P<end>[A-Za-z][^\s/>]*)[^>]*>?"""
    r"""|<(?P<start>[A-Za-z][^\s/>]*)(?P<attrs>(?:[^>"']++|"[^"]*+"|'[^']*+'|["'])*+)>?""",
    re.DOTALL,
)
_ATTRIBUTE = re.compile(
    r"""([^\s=>"'/]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+)))?""", re.DOTALL
)
_SPACE = re.compile(r"[ \t\n\f\r]+")
_HIDES = re.compile(r"display\s*:\s*none", re.IGNORECASE)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
_ALIGN = re.compile(r"text-align\s*:\s*(right|center)", re.IGNORECASE)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict[str, str] | None = None):
        self.tag, self.attrs = tag, attrs or {}
        self.children: list[Node | str] = []


def _attributes(text: str) -> dict[str, str]:
    found: dict[str, str] = {}
    if text.strip(" \t\n\f\r/"):
        for name, *values in _ATTRIBUTE.findall(text):
            found.setdefault(name.lower(), unescape("".join(values)))
    return found


class _Builder:
    """The tree of one page."""

    def __init__(self) -> None:
        self.root = Node("html")
        self.open = [self.root]
        self.count: dict[str, int] = {"html": 1}

    def _pop(self, to: int) -> None:
        for node in self.open[to:]:
            self.count[node.tag] -= 1
        del self.open[to:]

    def _find(self, tags: set[str] | frozenset[str], barriers: set[str] | frozenset[str]) -> int:
        """Position of the lowest of ``tags`` above the nearest barrier; 0 if there is none."""
        found = 0
        if any(self.count.get(t) for t in tags):
            for at in range(len(self.open) - 1, 0, -1):
                tag = self.open[at].tag
                if tag in tags:
                    found = at
                elif tag in barriers:
                    break
        return found

    def _table(self) -> int:
        """Position of the table whose structure is open, outside of its cells; 0 if there is none."""
        if self.count.get("table"):
            for at in range(len(self.open) - 1, 0, -1):
                tag = self.open[at].tag
                if tag == "table":
                    return at
                if tag in BARRIERS:
                    break
        return 0

    def _begun(self) -> bool:
        """Whether there was anything but white space before; a head behind that isn't one."""
        return len(self.open) > 1 or any(isinstance(c, Node) or c.strip() for c in self.root.children)

    def _put(self, child: Node | str) -> None:
        """Into the open element; what can't stand in a table goes before it, as in browsers."""
        if self.open[-1].tag in STRUCTURE and (at := self._table()):
            around = self.open[at - 1].children
            around.insert(len(around) - 1, child)  # an open table is the last child
        else:
            self.open[-1].children.append(child)

    def _push(self, node: Node) -> None:
        if len(self.open) < DEEPEST:
            self.open.append(node)
            self.count[node.tag] = self.count.get(node.tag, 0) + 1

    def _part(self, tag: str) -> None:
        """Back to the element that a part of the open table belongs into, with an implied row."""
        if at := self._table():
            to = len(self.open) - 1
            while to > at and self.open[to].tag not in PART_OF[tag] | (STRUCTURE if tag in CELLS else set()):
                to -= 1
            self._pop(to + 1)
            if tag in CELLS and self.open[-1].tag != "tr":
                row = Node("tr")
                self.open[-1].children.append(row)
                self._push(row)

    def text(self, text: str) -> None:
        if not text:
            return
        if self.open[-1].tag == "head" and text.strip(" \t\n\f\r"):
            self._pop(len(self.open) - 1)
        if text.strip(" \t\n\f\r"):
            self._put(text)
        else:
            self.open[-1].children.append(text)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag == "html" or (tag == "head" and self._begun()):
            return
        if self.count.get("head") and tag not in IN_HEAD and self.open[-1].tag == "head":
            self._pop(len(self.open) - 1)
        if tag in ENDS and (at := self._find(*ENDS[tag])):
            self._pop(at)
        elif tag in BLOCKS and tag not in CELLS and (at := self._find({"p"}, BARRIERS)):
            self._pop(at)
        if tag in HEADINGS and self.open[-1].tag in HEADINGS:
            self._pop(len(self.open) - 1)
        if tag in PART_OF:
            self._part(tag)
        elif tag == "table" and self.open[-1].tag in STRUCTURE and (at := self._table()):
            self._pop(at)  # a table right within another ends it
        node = Node(tag, attrs)
        if any(tag in NOT_DRAWN[x] and self.count.get(x) for x in NOT_DRAWN):
            node.attrs.setdefault("hidden", "")
        elif tag == "text" and self.count.get("svg"):
            self.open[-1].children.append(" ")  # labels of a picture stand apart
        in_structure = self.open[-1].tag in STRUCTURE
        if tag in PART_OF or tag in IN_TABLE:
            self.open[-1].children.append(node)
        else:
            self._put(node)
        if tag not in VOID and tag != "colgroup" and not (tag == "form" and in_structure):
            self._push(node)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.start("br", {})
        elif tag == "p" and not self._find({"p"}, BARRIERS):
            self.open[-1].children.append(Node("p"))
        elif tag in ("html", "body"):
            return  # what follows still belongs to the page
        elif self.count.get(tag):
            wall = {"table"} if tag in CELLS | SECTIONS | {"tr"} else BARRIERS - {tag}
            for at in range(len(self.open) - 1, 0, -1):
                if self.open[at].tag == tag:
                    self._pop(at)
                    return
                if self.open[at].tag in wall and tag != "table":
                    return


def build(html: str) -> Node:
    """The tree of a page with all implied tags."""
    builder, at = _Builder(), 0
    while token := _TOKEN.search(html, at):
        builder.text(unescape(html[at : token.start()]))
        at = token.end()
        if tag := token["end"]:
            builder.end(tag.lower())
        elif tag := token["start"]:
            tag, attrs = tag.lower(), token["attrs"]
            closed = attrs.endswith("/") and tag not in RAW
            builder.start(tag, _attributes(attrs.rstrip("/") if closed else attrs))
            if tag in RAW:
                close = re.compile(rf"</{tag}(?=[\s/>]|\Z)", re.IGNORECASE).search(html, at)
                stop = close.start() if close and tag != "plaintext" else len(html)
                inside = html[at:stop]
                builder.text(unescape(inside) if tag in ("textarea", "title") else inside)
                at = stop
        elif token[0].startswith("<![CDATA["):
            builder.text(token[0][9:].removesuffix("]]>"))
    builder.text(unescape(html[at:]))
    return builder.root


class _Lines:
    """Lines of one block; white space is folded as text arrives."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.gap = 0
        self.space = False  # a folded space before the next word

    def text(self, text: str, pre: bool) -> None:
        if pre:
            first, *more = text.replace("\r\n", "\n").split("\n")
            self._add(first)
            for line in more:
                self.line_break()
                self._add(line)
            return
        folded = _SPACE.sub(" ", text)
        if folded[:1] == " ":
            self.space = True
            folded = folded[1:]
        if folded:
            self._add((" " if self.space and self.parts else "") + folded.rstrip(" "))
            self.space = folded[-1] == " "

    def _add(self, text: str) -> None:
        if text:
            self.parts.append(text)
            self.space = False

    def line_break(self) -> None:
        self._put("".join(self.parts))
        self.parts = []
        self.space = False

    def _put(self, line: str) -> None:
        if self.lines:
            self.lines += [""] * self.gap
        self.gap = 0
        self.lines.append(line.replace("\xa0", " ").rstrip())

    def block(self, gap: int) -> None:
        """A block begins or ends here."""
        if self.parts:
            self.line_break()
        self.space = False
        self.gap = max(self.gap, gap)

    def extend(self, lines: list[str]) -> None:
        for line in lines:
            self._put(line)

    def done(self) -> list[str]:
        self.block(0)
        lines = self.lines
        first = next((i for i, x in enumerate(lines) if x), len(lines))
        while lines and not lines[-1]:
            lines.pop()
        return lines[first:]


def _number(text: str | None, default: int, most: int = 1000) -> int:
    try:
        return max(-most, min(most, int(text)))
    except (TypeError, ValueError):
        return default


def _shown(node: Node, shown: bool) -> bool | None:
    """Whether the node's own text is seen; None if nothing below it can be."""
    attrs, style = node.attrs, node.attrs.get("style", "")
    if node.tag in NOT_SHOWN or "hidden" in attrs or (style and _HIDES.search(style)):
        return None
    if node.tag == "dialog" and "open" not in attrs:
        return None
    if style and (rule := _VISIBILITY.search(style)):
        return rule[1].lower() == "visible"
    return shown


def _inside(node: Node, shown: bool, pre: bool, nested: bool) -> list[str]:
    out = _Lines()
    _children(node, out, shown, pre, nested)
    return out.done()


def _children(node: Node, out: _Lines, shown: bool, pre: bool, nested: bool) -> None:
    children = node.children
    if node.tag == "details" and "open" not in node.attrs:
        children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
    for child in children:
        if isinstance(child, Node):
            _render(child, out, shown, pre, nested)
        elif shown:
            out.text(child, pre)


def _render(node: Node, out: _Lines, shown: bool, pre: bool, nested: bool) -> None:
    seen = _shown(node, shown)
    tag = node.tag
    if seen is None:
        return
    if tag == "br":
        out.line_break()
    elif tag == "input":
        kind = node.attrs.get("type", "text").lower()
        if seen and kind in ("text", "submit", "button", "reset", "search", "email", "tel", "url", "number"):
            out.text(node.attrs.get("value", ""), False)
    elif tag == "select":
        if seen:
            out.text(_selected(node), False)
    elif tag == "q":
        if seen:
            out.text("“", False)
        _children(node, out, seen, pre, nested)
        if seen:
            out.parts.append("”")
    elif tag in LISTS:
        out.block(0 if nested else 1)
        _list(node, out, seen, pre)
        out.block(0 if nested else 1)
    elif tag == "table":
        out.block(1)
        out.extend(_table(node, seen, pre))
        out.block(1)
    elif tag in ("blockquote", "dd"):
        gap = int(tag == "blockquote")
        out.block(gap)
        out.extend(["    " + x if x else x for x in _inside(node, seen, pre, nested)])
        out.block(gap)
    elif tag in BLOCKS:
        gap = int(tag in APART)
        out.block(gap)
        _children(node, out, seen, pre or tag in ("pre", "listing", "xmp", "plaintext"), nested)
        out.block(gap)
    else:
        _children(node, out, seen, pre or tag == "textarea", nested)


def _selected(node: Node) -> str:
    """The text of the option that a closed list shows."""
    options, waiting = [], [node]
    while waiting:
        for child in waiting.pop(0).children:
            if isinstance(child, Node) and child.tag == "option":
                options.append(child)
            elif isinstance(child, Node):
                waiting.append(child)
    chosen = next((o for o in options if "selected" in o.attrs), options[0] if options else None)
    return " ".join(_inside(chosen, True, False, False)) if chosen else ""


def _list(node: Node, out: _Lines, shown: bool, pre: bool) -> None:
    number = _number(node.attrs.get("start"), 1, 10**9)
    for child in node.children:
        if not isinstance(child, Node):
            if shown:
                out.text(child, pre)
            continue
        if child.tag != "li":
            _render(child, out, shown, pre, True)
            continue
        seen = _shown(child, shown)
        if seen is None:
            continue
        number = _number(child.attrs.get("value"), number, 10**9)
        mark = f"{number}. " if node.tag == "ol" else "- "
        number += 1
        out.block(0)
        lines = _inside(child, seen, pre, True)
        indent = " " * len(mark)
        out.extend([(mark if i == 0 else indent if x else "") + x for i, x in enumerate(lines)])
        out.block(0)


def _rows(node: Node) -> list[Node]:
    """Rows in the order in which they are shown: head, bodies, foot."""
    parts: dict[str, list[Node]] = {"thead": [], "tbody": [], "tfoot": []}
    loose = None
    for child in node.children:
        if not isinstance(child, Node) or _shown(child, True) is None:
            continue
        if child.tag in SECTIONS:
            parts[child.tag] += [r for r in child.children if isinstance(r, Node) and r.tag == "tr"]
        elif child.tag == "tr":
            parts["tbody"].append(child)
            loose = None
        elif child.tag in CELLS:  # a cell without a row
            if loose is None:
                loose = Node("tr")
                parts["tbody"].append(loose)
            loose.children.append(child)
    return parts["thead"] + parts["tbody"] + parts["tfoot"]


def _still_open(spans: list[tuple[int, int, int]], row: int) -> list[tuple[int, int, int]]:
    """Spans that reach into a row, in order; neighbours that end together are one."""
    left: list[tuple[int, int, int]] = []
    for first, behind, free in sorted(spans):
        if free > row:
            if left and left[-1][1] == first and left[-1][2] == free:
                first = left.pop()[0]
            left.append((first, behind, free))
    return left


def _table(node: Node, shown: bool, pre: bool) -> list[str]:
    above = _Lines()
    for child in node.children:  # what isn't a part of a table stands before it
        if isinstance(child, str):
            if shown:
                above.text(child, pre)
        elif child.tag not in SECTIONS | CELLS | {"tr"}:
            _render(child, above, shown, pre, False)
    rows = [(row, seen) for row in _rows(node) if (seen := _shown(row, shown)) is not None]
    grid = []
    # Columns that cells of earlier rows reach into: (first, behind the last, row where they are free).
    spans: list[tuple[int, int, int]] = []
    for nr, (row, seen_row) in enumerate(rows):
        cells, opened, column, k = [], [], 0, 0
        for cell in row.children:
            if not isinstance(cell, Node) or cell.tag not in CELLS:
                continue
            while k < len(spans) and spans[k][0] <= column:
                column = max(column, spans[k][1])
                k += 1
            seen = _shown(cell, seen_row)
            if seen is None:
                continue
            wide = max(1, _number(cell.attrs.get("colspan"), 1))
            high = max(1, _number(cell.attrs.get("rowspan"), 1, 65534))
            style = _ALIGN.search(cell.attrs.get("style", ""))
            align = (style[1] if style else cell.attrs.get("align", "")).lower()
            cells.append((column, wide, _inside(cell, seen, pre, False), align))
            if high > 1:
                opened.append((column, column + wide, min(nr + high, len(rows))))
            column += wide
        if opened or any(free == nr + 1 for _, _, free in spans):
            spans = _still_open([*spans, *opened], nr + 1)
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        for column, wide, lines, _ in cells:
            if wide == 1:
                width = max(map(len, lines), default=0)
                widths[column] = max(widths.get(column, 0), min(width, WIDEST_COLUMN))
            else:
                widths.setdefault(column, 0)
    columns = sorted(widths)
    starts, at = {}, 0
    for column in columns:
        starts[column] = at
        at += widths[column] + 2 if widths[column] else 0
    out = above.done()
    for cells in grid:
        for k in range(max((len(lines) for _, _, lines, _ in cells), default=0)):
            line = ""
            for column, wide, lines, align in cells:
                text = lines[k] if k < len(lines) else ""
                if text:
                    width = widths[column] if wide == 1 else 0
                    text = text.rjust(width) if align == "right" else text
                    text = text.center(width) if align == "center" else text
                    room = len(line) <= max(0, starts[column] - 2) and starts[column] <= WIDEST_LINE
                    line = (line.ljust(starts[column]) if room else line + "  ") + text
            out.append(line.rstrip())
    return out


def visible_text(html: str | None) -> str | None:
    """What a reader sees of a page, as text."""
    if html is None:
        return None
    return "\n".join(_inside(build(html), True, False, False))


def _all(pages: pa.Array) -> pa.Array:
    return pa.array([visible_text(p.as_py()) for p in pages], pa.string())


def extract_text(pages: DataFrame, *, html: str = "html", into: str = "text") -> DataFrame:
    """``pages`` and the visible text of each."""
    whole_texts(pages.sparkSession)
    return pages.withColumn(into, F.arrow_udf(_all, "string")(F.col(html)))
