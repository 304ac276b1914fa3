"""HTML extraction by layout-aware rendering.

A tokenizer reads each character a bounded number of times; what is unfinished at the end of the page (a tag, a comment) is
dropped, as browsers do. A tree builder applies the implied end tags of HTML; visibility rules drop elements that a browser
would not show (`visibility` is inherited and may be turned back on inside; a closed `details` shows its summary); a renderer writes every visible text in order, with blank lines around blocks, list markers, preformatted text kept,
and the cells of data tables padded to the width of their columns.

Neither builder nor renderer recurses with the nesting, and what they write is bounded by a small factor of the page:

- indents of nested lists, quotes and definitions end at `INDENT` columns;
- a table that holds another table is a layout table, whose cells are blocks one below the other;
- in a data table, cells wider than `ALIGN` columns neither widen their column nor are padded, and a cell that spans
  columns is padded to at most four times that;
- a cell that spans rows keeps its columns free in the next rows, for `ROWS` rows at most;
- a row in which a cell has several lines writes its cells one below the other.

Null and empty pages give an empty text. Malformed declarations are comments, as browsers read them; numbers of more than
nine digits in attributes are ignored. Repeated rows are each rendered; other columns are kept, but `text` is replaced.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.common import small_batches

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript noframes noembed title iframe object datalist audio video canvas rp metadata defs desc".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html li main menu nav ol optgroup option p pre section summary table ul legend caption".split())
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 ol p pre table ul menu".split())
LISTS = frozenset("ul ol menu".split())
#: An opening tag ends these open elements, up to the nearest element of the second set.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "tbody": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}),
    "tfoot": ({"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, {"table"}), "option": ({"option"}, {"select"}), "body": ({"head"}, {"html"}),
}
#: Elements whose content is text up to their end tag: without and with character references.
RAW, RAW_REFS = frozenset("script style xmp iframe noembed noframes".split()), frozenset("title textarea".split())
_STYLE = re.compile(r"(?:^|;)\s*(display|visibility)\s*:\s*([a-z-]+)", re.I)
_TAG = re.compile(r"<(?:(/?)([a-zA-Z][^\t\n\r\f />]*)|(!--)|[!?]|/(?=.))", re.S)
_GAP, _NAME, _EQUALS, _BARE = (re.compile(x) for x in (r"[\t\n\r\f /]*", r"[^\t\n\r\f />][^\t\n\r\f />=]*", r"[\t\n\r\f ]*=[\t\n\r\f ]*", r"[^\t\n\r\f >]+"))
_COMMENT_END = re.compile("--!?>")
_SPACE = re.compile("[ \t\n\r\f]+")
_NUMBER = re.compile(r"\s*([+-]?[0-9]{1,9})(?![0-9])")
#: Layout bounds in columns, and rows that a cell can span.
INDENT, ALIGN, ROWS = 40, 40, 32


class Node:
    """`ghost`: keeps its place, but its own texts are not shown (`visibility`)."""

    __slots__ = ("attrs", "ghost", "kids", "nested", "tag")

    def __init__(self, tag: str, attrs: dict[str, str | None], ghost: bool = False) -> None:
        self.tag, self.attrs, self.kids, self.nested, self.ghost = tag, attrs, [], False, ghost

    def style(self, name: str) -> str | None:
        """What the element's own style says of a property, last."""
        own = self.attrs.get("style")
        return {k.lower(): v.lower() for k, v in _STYLE.findall(own)}.get(name) if own else None

    def number(self, name: str, default: int) -> int:
        found = _NUMBER.match(self.attrs.get(name) or "")
        return int(found[1]) if found else default


def tokens(html: str) -> Iterator[tuple[str, str, list]]:
    """("text", data, []), ("start", tag, attributes) and ("end", tag, []) in order.

    Every step goes on where the last one stopped, and what has no end runs to the end of the page, so time is linear.
    """
    at, begin, n = 0, 0, len(html)
    while (at := html.find("<", at)) >= 0:
        found = _TAG.match(html, at)
        if not found:
            at += 1
            continue
        if begin < at:
            yield "text", unescape(html[begin:at]), []
        tag, begin = found[2], n
        if not tag:
            end = _COMMENT_END.search(html, at + 2) if found[3] else None
            stop = end.end() if end else 0 if found[3] else html.find(">", at + 1) + 1
            if not stop:
                return
            at = begin = stop
            continue
        at, attrs, tag = found.end(), [], tag.lower()
        while True:
            at = _GAP.match(html, at).end()
            if at >= n:
                return
            if html[at] == ">":
                break
            name = _NAME.match(html, at)
            equals, value = _EQUALS.match(html, name.end()), None
            at = equals.end() if equals else name.end()
            if equals and html[at : at + 1] in ('"', "'"):
                end = html.find(html[at], at + 1)
                if end < 0:
                    return
                value, at = html[at + 1 : end], end + 1
            elif equals:
                bare = _BARE.match(html, at)
                value, at = (bare[0], bare.end()) if bare else ("", at)
            attrs.append((name[0].lower(), unescape(value) if value else value))
        at = begin = at + 1
        if found[1]:
            yield "end", tag, []
            continue
        yield "start", tag, attrs
        if tag in RAW or tag in RAW_REFS:
            end = re.compile(rf"</{tag}(?=[\t\n\r\f />])", re.I).search(html, at)
            stop = end.start() if end else n
            if at < stop:
                yield "text", html[at:stop] if tag in RAW else unescape(html[at:stop]), []
            at = begin = stop
    if begin < n:
        yield "text", unescape(html[begin:]), []


class Builder:
    """The tree of a page. `at` holds the places of the open elements by tag, so that no step walks the open elements."""

    def __init__(self) -> None:
        self.root = Node("html", {})
        self.open = [self.root]
        self.at: dict[str, list[int]] = {}

    def feed(self, html: str) -> Node:
        for kind, what, attrs in tokens(html):
            if kind == "text":
                self.handle_data(what)
            elif kind == "start":
                self.handle_starttag(what, attrs)
            else:
                self.handle_endtag(what)
        return self.root

    def _last(self, tag: str) -> int:
        places = self.at.get(tag)
        return places[-1] if places else -1

    def _cut(self, i: int) -> None:
        for node in self.open[i:]:
            self.at[node.tag].pop()
        del self.open[i:]

    def _end(self, tags: set[str], until: set[str]) -> None:
        """Close open elements of `tags` that lie above the nearest element of `until`."""
        floor, lowest = max(map(self._last, until)), None
        for tag in tags:
            places = self.at.get(tag)
            if places and places[-1] > floor:
                first = places[bisect_right(places, floor)]
                lowest = first if lowest is None else min(lowest, first)
        if lowest is not None:
            self._cut(lowest)

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "html":
            return
        if tag in BLOCK:
            self._end({"p"}, {"td", "th", "table", "button"})
        if tag in IMPLIED:
            self._end(*IMPLIED[tag])
        if self.open[-1].tag == "head" and tag in BLOCK:
            self._cut(len(self.open) - 1)
        node = Node(tag, dict(reversed(attrs)), self.open[-1].ghost)
        own = node.style("visibility")
        if own in ("visible", "hidden", "collapse"):
            node.ghost = own != "visible"
        self.open[-1].kids.append(node)
        if tag == "table" and self._last("table") > 0:
            self.open[self._last("table")].nested = True
        if tag not in VOID:
            self.at.setdefault(tag, []).append(len(self.open))
            self.open.append(node)

    def handle_endtag(self, tag: str) -> None:
        i = self._last(tag)
        if i < 0:
            if tag == "p":
                self.open[-1].kids.append(Node("p", {}))
        elif tag in ("table", "body", "html") or self._last("table") < i:
            self._cut(i)

    def handle_data(self, data: str) -> None:
        if not self.open[-1].ghost:
            self.open[-1].kids.append(data)


def visible(node: Node) -> bool:
    if node.tag in HIDDEN or "hidden" in node.attrs or (node.tag == "dialog" and "open" not in node.attrs):
        return False
    if node.tag == "input" and node.attrs.get("type") == "hidden":
        return False
    return node.style("display") != "none"


def _shown(node: Node) -> list:
    """The kids of an element that is visible: of a closed `details` only the summary."""
    if node.tag == "details" and "open" not in node.attrs:
        return [k for k in node.kids if not isinstance(k, str) and k.tag == "summary"][:1]
    return node.kids


def _marker(number: int, kind: str | None) -> str:
    """A list number as decimal, letters or Roman figures; what these cannot write is decimal."""
    if kind in ("a", "A") and number > 0:
        out = ""
        while number:
            number, digit = divmod(number - 1, 26)
            out = chr(97 + digit) + out
        return out if kind == "a" else out.upper()
    if kind in ("i", "I") and 0 < number < 4000:
        out = ""
        for value, sign in zip((1000, 900, 500, 400, 100, 90, 50, 40, 10, 9, 5, 4, 1), "m cm d cd c xc l xl x ix v iv i".split(), strict=True):
            out += sign * (number // value)
            number %= value
        return out if kind == "i" else out.upper()
    return str(number)


def _width(text: str) -> int:
    return sum(0 if unicodedata.combining(c) else 2 if unicodedata.east_asian_width(c) in "WF" else 1 for c in text) if not text.isascii() else len(text)


class Writer:
    """Lines of output. `gap` is how many line ends are due before the next text, `indent` the columns before each line,
    `mark` the list marker before the next one; `fresh` while an item or cell has no text yet."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line, self.gap, self.space, self.started = "", 0, False, False
        self.indent, self.mark, self.fresh = 0, "", True

    def _start(self) -> None:
        if self.started:
            return
        if self.gap and self.lines:
            self.lines += [""] * (self.gap - 1)
        lead = min(self.indent, INDENT)
        self.line = " " * max(0, lead - len(self.mark)) + self.mark
        self.gap, self.space, self.mark, self.fresh, self.started = 0, False, "", False, True
        self.begin = len(self.line)

    def text(self, data: str) -> None:
        shown = _SPACE.sub(" ", data)
        if shown.startswith(" "):
            self.space = True
        body = shown.strip(" ")
        if body:
            self._start()
            if self.space and len(self.line) > self.begin and not self.line.endswith(" "):
                self.line += " "
            self.line += body
            self.space = shown.endswith(" ")

    def raw(self, data: str) -> None:
        first, *rest = data.split("\n")
        if first or rest:
            self._start()
            self.line += first
        for x in rest:
            self._flush()
            self._start()
            self.line += x

    def _flush(self) -> None:
        self.lines.append(self.line.rstrip())
        self.line, self.space, self.started = "", False, False

    def end(self, gap: int) -> None:
        if self.started and self.line[self.begin :].strip():
            self._flush()
            self.gap = gap
        else:
            if self.started and not self.line.strip():
                self.line, self.started = "", False
            if self.lines and not self.fresh:
                self.gap = max(self.gap, gap)
        self.space = False

    def br(self) -> None:
        self._start()
        self._flush()

    def done(self) -> list[str]:
        self.end(1)
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


def _rows(table: Node) -> tuple[list, list[list]]:
    """A table's stray visible children (captions), and its rows of cells."""
    stray, rows, todo = [], [], [*reversed(table.kids)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                stray.append(x)
        elif not visible(x):
            continue
        elif x.tag in ("thead", "tbody", "tfoot"):
            todo += reversed(x.kids)
        elif x.tag == "tr":
            rows.append([c for c in x.kids if not isinstance(c, str) and visible(c)] + [c for c in x.kids if isinstance(c, str) and c.strip()])
        elif x.tag in ("td", "th"):
            rows.append([x])
        else:
            stray.append(x)
    return stray, rows


def _data_table(rows: list[list]) -> list[str]:
    """Aligned lines of a table without tables in it."""
    grid = []
    busy: list[tuple[int, int, int]] = []  # columns that a cell from above holds: first, end, last row
    for r, row in enumerate(rows):
        cells, at = [], 0
        busy = [x for x in busy if x[2] >= r]
        held, new = iter([*busy, (1 << 60, 1 << 60, 0)]), []
        block = next(held)
        for cell in row:
            own = Writer()
            _render([cell] if isinstance(cell, str) or cell.tag not in ("td", "th") else cell.kids, own)
            span, down = (min(1000, max(1, cell.number("colspan", 1))), cell.number("rowspan", 1)) if isinstance(cell, Node) else (1, 1)
            while at >= block[0]:
                at, block = max(at, block[1]), next(held)
            cells.append((own.done(), span, at))
            if down != 1:
                new.append((at, at + span, r + (min(down, ROWS) if down > 0 else ROWS) - 1))
            at += span
        if new:
            busy = sorted(busy + new)
        grid.append(cells)
    widths: dict[int, int] = {}
    for cells in grid:
        plain = all(len(lines) <= 1 for lines, _, _ in cells)
        for lines, span, at in cells:
            if span == 1 and plain and lines:
                wide = _width(lines[0])
                widths[at] = max(widths.get(at, 0), wide if wide <= ALIGN else 0)
    known = sorted(widths)
    out: list[str] = []

    def blank(lo: int, hi: int) -> list[int]:
        return [widths[k] for k in known[bisect_left(known, lo) : bisect_left(known, hi)] if widths[k]]

    for cells in grid:
        if any(len(lines) > 1 for lines, _, _ in cells):
            out += [line for lines, _, _ in cells for line in lines]
            continue
        line, upto = [], 0
        for lines, span, at in cells:
            line += [" " * (w + 2) for w in blank(upto, at)]
            text = lines[0] if lines else ""
            held_ = blank(at, at + span)
            wide = min(sum(held_) + 2 * max(0, len(held_) - 1), 4 * ALIGN)
            line.append(text + " " * max(0, wide - _width(text)) + "  ")
            upto = at + span
        if any(lines for lines, _, _ in cells):
            out.append("".join(line).rstrip())
    return out


def _render(kids: list, out: Writer) -> None:
    """Write kids in order. `todo` holds what is still to come, last first: nodes, texts, and steps that close a node."""
    pre, lists = 0, []  # open preformatted elements; numbers of the open lists (None without numbers)
    todo: list = [*reversed(kids)]
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            out.raw(x) if pre else out.text(x)
            continue
        if isinstance(x, tuple):
            tag, gap, indent = x
            out.end(gap)
            if tag == "li":
                out.gap, out.mark, out.fresh = (1 if out.lines else 0), "", False
            elif tag in LISTS:
                lists.pop()
                out.gap = gap if out.lines else 0
            elif tag == "pre":
                pre -= 1
            out.indent = indent
            continue
        if not visible(x):
            continue
        tag = x.tag
        if tag == "br":
            out.br()
        elif tag == "hr":
            out.end(1)
        elif tag == "img":
            if x.attrs.get("alt") and not x.ghost:
                out.text(x.attrs["alt"])
        elif tag == "input":
            if x.attrs.get("type") in ("submit", "button", "reset") and x.attrs.get("value") and not x.ghost:
                out.text(f" {x.attrs['value']} ")
        elif tag == "table" and not x.nested:
            stray, rows = _rows(x)
            out.end(2)
            todo += [("table", 2, out.indent), _Lines(rows), *reversed(stray)]
        elif isinstance(x, _Lines):
            out.end(1)
            for line in _data_table(x.kids):
                out._start()
                out.line += line
                out._flush()
                out.gap = 1
            out.gap = 1 if out.lines else 0
        elif tag in LISTS:
            gap = 1 if lists else 2
            out.end(gap)
            todo.append((tag, gap, out.indent))
            step = -1 if "reversed" in x.attrs else 1
            first = 1 if step > 0 else sum(not isinstance(k, str) and k.tag == "li" for k in x.kids)
            lists.append([x.number("start", first), step, x.attrs.get("type")] if tag == "ol" else None)
            todo += [k for k in reversed(x.kids) if not isinstance(k, str) or k.strip()]
        elif tag == "li":
            out.end(1)
            out.gap = min(out.gap, 1)
            mark = "- "
            if lists and lists[-1] is not None:
                following, step, kind = lists[-1]
                own = x.number("value", following)
                mark, lists[-1][0] = f"{_marker(own, x.attrs.get('type') or kind)}. ", own + step
            if x.ghost:
                mark = " " * len(mark)
            todo.append(("li", 1, out.indent))
            out.indent += len(mark)
            out.mark = _mark(out.mark, mark)
            out.fresh = True
            todo += reversed(x.kids)
        elif tag in ("blockquote", "dd"):
            gap = 2 if tag == "blockquote" else 1
            out.end(gap)
            todo.append((tag, gap, out.indent))
            out.indent += 2
            todo += reversed(x.kids)
        elif tag in ("pre", "textarea"):
            out.end(2 if tag == "pre" else 1)
            pre += 1
            todo.append(("pre", 2 if tag == "pre" else 1, out.indent))
            body = [*reversed(x.kids)]
            if body and isinstance(body[-1], str):
                body[-1] = body[-1].removeprefix("\n")  # as in browsers
            todo += body
        elif tag in BLOCK or tag in ("tr", "td", "th", "tbody", "thead", "tfoot"):
            gap = 2 if tag in SPACED else 1
            out.end(gap)
            todo.append((tag, gap, out.indent))
            todo += reversed(_shown(x))
        else:
            todo += reversed(x.kids)


def _mark(open_mark: str, own: str) -> str:
    """The marker of an item that starts where another has no text yet: both stand side by side, within the indent's bound."""
    return open_mark + own if len(open_mark) + len(own) <= INDENT else own


class _Lines(Node):
    """The rows of a data table, once what stands outside its rows is written."""

    __slots__ = ()

    def __init__(self, rows: list) -> None:
        super().__init__("#rows", {})
        self.kids = rows


def render(html: str | None) -> str:
    if not html:
        return ""
    out = Writer()
    _render(Builder().feed(html).kids, out)
    return "\n".join(out.done())


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """pages without the html column, and text."""

    @F.pandas_udf("string")
    def run(html: pd.Series) -> pd.Series:
        return html.map(render, na_action=None) if len(html) else html

    return small_batches(pages).select(*[c for c in pages.columns if c not in (html_col, "text")], run(F.col(html_col)).alias("text"))
