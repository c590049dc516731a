"""HTML extraction by layout-aware rendering.

A tree builder closes and opens tags as a browser would (implied end tags,
void elements, stray end tags); visibility rules drop what isn't shown; a
renderer emits all visible text: blocks on lines of their own, a blank line
around paragraphs and headings, list markers with indentation, table cells in
aligned columns, and preformatted text as it is.

Scale: row by row in one pass, no shuffle; a page is held by one task.

Defined cases: null html gives null, empty html and html without visible text
the empty string; broken markup never fails nor ends the text; elements may be
nested to any depth; a table's columns are as wide as their widest cell, but
where blanks to pad with would come to more than ``PADDING`` times the table's
own text, so that a page's text grows no faster than the page, the widest cells
stick out; repeated rows give equal results.
"""

from __future__ import annotations

import re
import sys
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..markup import Tokeniser
from ..shipping import ship

PADDING = 32

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas datalist param area".split())
#: Blocks with a blank line around, and other blocks.
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 blockquote ul ol dl menu dir table pre figure hr fieldset".split())
BLOCK = SPACED | frozenset("html body address article aside center details dialog div dd dt figcaption footer form header hgroup legend li main nav optgroup option search section summary tr caption thead tbody tfoot td th".split())
#: A tag on the left ends an open element on the right, unless one of the scope lies between.
_ENDS_P = frozenset("address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section table ul li dd dt summary".split())
_LISTS = frozenset("ul ol menu dir".split())
_TABLE = frozenset(["table"])
_CLOSES: dict[str, tuple[frozenset, frozenset]] = {
    "li": (frozenset(["li"]), _LISTS),
    "dt": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "dd": (frozenset(["dt", "dd"]), frozenset(["dl"])),
    "option": (frozenset(["option"]), frozenset(["select", "datalist"])),
    "optgroup": (frozenset(["option", "optgroup"]), frozenset(["select"])),
    "tr": (frozenset(["tr", "td", "th", "caption", "colgroup"]), _TABLE),
    "td": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    "th": (frozenset(["td", "th"]), frozenset(["tr", "table"])),
    **{t: (frozenset(["thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"]), _TABLE) for t in ("thead", "tbody", "tfoot")},
    "body": (frozenset(["head"]), frozenset()),
    "rt": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
    "rp": (frozenset(["rt", "rp"]), frozenset(["ruby"])),
}
_HEADINGS = frozenset(["h1", "h2", "h3", "h4", "h5", "h6"])
#: End tags of these don't reach beyond a table cell and its like.
_SCOPE = frozenset("table td th caption html template".split())
_SPACE = re.compile(r"[ \t\n\r\f]+")
#: What may stand in a head; anything else begins the body.
_HEAD = frozenset("base link meta title style script noscript template head html".split())


class Node:
    __slots__ = ("attrs", "children", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None]):
        self.tag, self.attrs, self.children = tag, attrs, []


class Builder(Tokeniser):
    """Builds the tree under ``root``; ``path`` holds the open elements, ``open`` how many there are of each tag."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = Node("html", {})
        self.path = [self.root]
        self.open: Counter[str] = Counter()

    def _leave(self, k: int) -> None:
        """Close the open elements from number k on."""
        for node in self.path[k:]:
            self.open[node.tag] -= 1
        del self.path[k:]

    def _close(self, tags: frozenset, scope: frozenset) -> None:
        if not any(self.open[t] for t in tags):
            return
        for k in range(len(self.path) - 1, 0, -1):
            tag = self.path[k].tag
            if tag in tags:
                # all of those that are open one in another go together
                while k > 1 and self.path[k - 1].tag in tags:
                    k -= 1
                self._leave(k)
                return
            if tag in scope:
                return

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        if tag == "html":
            for k, v in attrs:
                self.root.attrs.setdefault(k, v)
            return
        if tag not in _HEAD:
            self._close(frozenset(["head"]), frozenset())
        if tag in _ENDS_P:
            self._close(frozenset(["p"]), _SCOPE | {"button"})
        if tag in _HEADINGS and self.path[-1].tag in _HEADINGS:
            self._leave(len(self.path) - 1)
        if tag in _CLOSES:
            self._close(*_CLOSES[tag])
        if tag in ("td", "th") and self.path[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._open("tr", {})
        self._open(tag, dict(reversed(attrs)))  # of equal attributes the first counts
        if tag in VOID:
            self._leave(len(self.path) - 1)

    def _open(self, tag: str, attrs: dict) -> None:
        node = Node(tag, attrs)
        self.path[-1].children.append(node)
        self.path.append(node)
        self.open[tag] += 1

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs)  # the slash means nothing in HTML

    def handle_endtag(self, tag: str) -> None:
        if tag == "br":
            self.handle_starttag("br", [])
            return
        if tag in ("html", "body") or tag in VOID:
            return
        tags = _HEADINGS if tag in _HEADINGS else frozenset([tag])
        if not any(self.open[t] for t in tags):
            self._stray(tag)
            return
        scope = _LISTS | _SCOPE if tag == "li" else frozenset(["table"]) if tag in ("tr", "td", "th", "thead", "tbody", "tfoot") else frozenset() if tag in ("table", "template") else _SCOPE
        for k in range(len(self.path) - 1, 0, -1):
            if self.path[k].tag in tags:
                self._leave(k)
                return
            if self.path[k].tag in scope:
                return
            if tag not in BLOCK and self.path[k].tag in BLOCK:
                return  # an inline end tag doesn't close blocks

    def _stray(self, tag: str) -> None:
        if tag == "p":
            self._open("p", {})
            self._leave(len(self.path) - 1)

    def handle_data(self, data: str) -> None:
        if self.path[-1].tag == "head" and data.strip():
            self._leave(len(self.path) - 1)
        self.path[-1].children.append(data)


def _declared(node: Node) -> dict[str, str]:
    """Declarations of the style attribute; of several for a property the last counts."""
    out = {}
    for declaration in (node.attrs.get("style") or "").split(";"):
        name, _, value = declaration.partition(":")
        if words := value.lower().replace("!", " ").split():
            out[name.strip().lower()] = words[0]
    return out


def show(node: Node, seen: bool = True) -> Node | None:
    """The tree without what isn't shown; None if that is all.

    What isn't displayed goes with all in it.  What is only invisible keeps its
    place, without texts, and what is in it may be visible again.
    """
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return None
    style = _declared(node) if "style" in node.attrs else {}
    if style.get("display") == "none" or style.get("content-visibility") == "hidden":
        return None
    own = style.get("visibility")
    if own == "collapse" and node.tag in ("tr", "thead", "tbody", "tfoot"):
        return None
    if own not in (None, "inherit", "unset"):
        seen = own not in ("hidden", "collapse")
    if node.tag == "input" and not seen:
        return None
    out = Node(node.tag, node.attrs)
    for c in node.children:
        if isinstance(c, str):
            if seen:
                out.children.append(c)
        elif kept := show(c, seen):
            out.children.append(kept)
    return out


class Lines:
    """Lines of a box; blocks are set apart by line ends or blank lines."""

    def __init__(self, tight: bool = False) -> None:
        self.tight = tight  # inside a list item: a list in it has no blank lines around
        self.lines: list[str] = []
        self.now: list[str] = []
        self.gap = False

    def end(self, spaced: bool = False) -> None:
        line = "".join(self.now).strip(" ")
        self.now = []
        if line:
            self._put(line)
        self.gap |= spaced

    def _put(self, line: str) -> None:
        if self.gap and self.lines:
            self.lines.append("")
        self.gap = False
        self.lines.append(line)

    def text(self, s: str) -> None:
        s = _SPACE.sub(" ", s)
        if s.startswith(" ") and (not self.now or self.now[-1].endswith(" ")):
            s = s[1:]
        if s:
            self.now.append(s)

    def br(self) -> None:
        if self.now:
            self.end()
        elif self.lines:
            self.gap = True

    def block(self, lines: list[str], spaced: bool) -> None:
        self.end(spaced)
        for k, line in enumerate(lines):
            self._put(line) if k == 0 else self.lines.append(line)
        self.gap |= spaced


def _listed(node: Node) -> list[str]:
    """A list: each item after its marker, further lines indented."""
    out: list[str] = []
    ordered, start = node.tag == "ol", node.attrs.get("start") or ""
    number = int(start) if ordered and re.fullmatch(r"-?\d{1,9}", start) else 1
    rest = Lines()
    for child in node.children:
        if isinstance(child, Node) and child.tag == "li":
            out += rest.lines
            rest = Lines()
            own = child.attrs.get("value") or ""
            number = int(own) if ordered and re.fullmatch(r"-?\d{1,9}", own) else number
            marker = f"{number}. " if ordered else "- "
            number += 1
            lines = _box(child.children, True)
            if lines:
                out += [marker + lines[0], *[" " * len(marker) + x if x else x for x in lines[1:]]]
        else:
            inner = Lines()
            _into(inner, [child])
            inner.end()
            rest.lines += ["  " + x if x else x for x in inner.lines]
    return out + rest.lines


def _sections(node: Node) -> list[list[Node]]:
    """Rows by section; rows outside of any are sections by their runs."""
    out: list[list[Node]] = []
    loose = False
    for child in node.children:
        if isinstance(child, Node):
            if child.tag == "tr":
                out[-1].append(child) if loose else out.append([child])
                loose = True
            elif child.tag in ("thead", "tbody", "tfoot"):
                out += _sections(child)
                loose = False
    return out


def _number(cell: Node, name: str, most: int) -> int:
    s = (cell.attrs.get(name) or "1").strip()
    return min(int(s), most) if re.fullmatch(r"[0-9]{1,9}", s) else 1


def _grid(sections: list[list[Node]]) -> list[list[tuple[int, int, list[str]]]]:
    """By row, (column, columns, lines) of its cells; a cell over several rows keeps its columns from the rows below."""
    grid = []
    for rows in sections:
        taken: dict[int, int] = {}  # rows still to be kept free, by column
        for nth, row in enumerate(rows):
            cells, extra, at = [], [], 0
            now, taken = taken, {c: n - 1 for c, n in taken.items() if n > 1}
            for c in row.children:
                if not (isinstance(c, Node) and c.tag in ("td", "th")):
                    extra.append(c)
                    continue
                while at in now:
                    at += 1
                wide, high = max(1, _number(c, "colspan", 1000)), _number(c, "rowspan", 65534)
                cells.append((at, wide, _box(c.children)))
                down = (high or len(rows)) - 1
                if down and nth + 1 < len(rows):
                    taken.update({x: max(down, taken.get(x, 0)) for x in range(at, at + wide)})
                at += wide
            if lines := _box(extra):
                while at in now:
                    at += 1
                cells.append((at, 1, lines))
            grid.append(cells)
    # columns at which no cell begins are no columns of their own
    n = 1 + max((at for row in grid for at, *_ in row), default=0)
    return [[(at, min(wide, n - at), lines) for at, wide, lines in row] for row in grid]


def _fitting(sizes: list[int], budget: int) -> int:
    """The greatest size up to which all smaller ones may be padded."""
    sizes = sorted(sizes)
    less = sum(sizes)
    for k in range(len(sizes) - 1, 0, -1):
        less -= sizes[k]
        if k * sizes[k] - less <= budget:
            return sizes[k]
    return sizes[0] if sizes else 0


def _widths(grid: list[list[tuple[int, int, list[str]]]]) -> dict[int, int]:
    """The width of each column."""
    by_column: dict[int, list[int]] = {}
    for row in grid:
        for at, wide, lines in row:
            if wide == 1:
                by_column.setdefault(at, []).append(max(map(len, lines), default=0))
    budget = PADDING * (1024 + sum(len(x) for row in grid for *_, lines in row for x in lines))
    most = max((n * max(sizes) for sizes in by_column.values() if (n := len(sizes))), default=0)
    width = {at: max(sizes) if most <= budget else _fitting(sizes, budget) for at, sizes in by_column.items()}
    for row in grid:
        for at, wide, lines in row:
            if wide > 1:
                short = max(map(len, lines), default=0) - sum(width.get(x, 0) for x in range(at, at + wide)) - 3 * (wide - 1)
                if 0 < short * len(grid) <= budget:
                    width[at + wide - 1] = width.get(at + wide - 1, 0) + short
    return width


def _table(node: Node) -> list[str]:
    """Cells in columns, each as wide as its widest line; what isn't in cells comes first."""
    out = Lines()
    loose: list = []
    for child in node.children:
        if not (isinstance(child, Node) and child.tag in ("tr", "thead", "tbody", "tfoot", "col", "colgroup")):
            loose.append(child)
        elif child.tag in ("thead", "tbody", "tfoot"):
            loose += [c for c in child.children if not (isinstance(c, Node) and c.tag == "tr")]
    _into(out, loose)
    out.end()
    grid = _grid(_sections(node))
    width = _widths(grid)
    for row in grid:
        for k in range(max((len(lines) for *_, lines in row), default=0)):
            line, past = [], 0
            for at, wide, lines in row:
                line += [" " * width.get(x, 0) for x in range(past, at)]  # columns of cells from above
                line.append((lines[k] if k < len(lines) else "").ljust(sum(width.get(x, 0) for x in range(at, at + wide)) + 3 * (wide - 1)))
                past = at + wide
            if text := " | ".join(line).rstrip():
                out.lines.append(text if text.strip(" |") else "")
    return out.lines


def _pre(node: Node) -> list[str]:
    parts: list[str] = []

    def walk(children: list) -> None:
        for c in children:
            if isinstance(c, str):
                parts.append(c)
            elif c.tag == "br":
                parts.append("\n")
            else:
                walk(c.children)

    walk(node.children)
    lines = "".join(parts).replace("\r\n", "\n").replace("\r", "\n").split("\n")
    while lines and not lines[0].strip():
        lines.pop(0)
    while lines and not lines[-1].strip():
        lines.pop()
    return [x.rstrip() for x in lines]


def _into(out: Lines, children: list) -> None:
    for c in children:
        if isinstance(c, str):
            out.text(c)
            continue
        tag = c.tag
        if tag == "br":
            out.br()
        elif tag == "hr":
            out.end(True)
        elif tag in _LISTS:
            out.block(_listed(c), not out.tight)
        elif tag == "table":
            out.block(_table(c), True)
        elif tag == "pre":
            out.block(_pre(c), True)
        elif tag == "blockquote":
            out.block(["> " + x if x else ">" for x in _box(c.children)], True)
        elif tag == "dd":
            out.block(["  " + x if x else x for x in _box(c.children)], False)
        elif tag == "details" and "open" not in c.attrs:
            out.block(_box([x for x in c.children if isinstance(x, Node) and x.tag == "summary"][:1]), False)
        elif tag == "input":
            kind = (c.attrs.get("type") or "text").lower()
            if kind in ("submit", "button", "reset", "text") and c.attrs.get("value"):
                out.text(c.attrs["value"])
        elif tag == "textarea":
            out.block(_pre(c), False)
        elif tag in BLOCK:
            spaced = tag in SPACED
            out.end(spaced)
            _into(out, c.children)
            out.end(spaced)
        else:
            if tag in ("td", "th"):
                out.text(" ")
            _into(out, c.children)


def _box(children: list, tight: bool = False) -> list[str]:
    out = Lines(tight)
    _into(out, children)
    out.end()
    return out.lines


def render(html: str | None) -> str | None:
    """All visible text of a page."""
    if html is None:
        return None
    builder = Builder()
    builder.feed(html)
    builder.close()
    before = sys.getrecursionlimit()
    # an element takes up to three calls; calls between Python functions need no machine stack
    sys.setrecursionlimit(max(before, 10_000 + 4 * html.count("<")))
    try:
        root = show(builder.root)
        return "\n".join(_box(root.children)) if root else ""
    finally:
        sys.setrecursionlimit(before)


def rendered(pages: DataFrame, html: str = "html", to: str = "rendered") -> DataFrame:
    """``pages`` with all its columns and ``to``."""
    ship(pages.sparkSession)

    @F.arrow_udf("string")
    def of(pages_html: pa.Array) -> pa.Array:
        return pa.array([render(x.as_py()) for x in pages_html], pa.string())

    return pages.withColumn(to, of(F.col(html).cast("string")))
