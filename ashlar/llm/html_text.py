"""HTML extraction by layout-aware rendering: a tree with implied tags, visibility rules, then the visible text laid out in lines."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from html import unescape

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ashlar.llm.common import table

# Elements by kind, as HTML defines them.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
NOT_SHOWN = frozenset("head script style template noscript iframe object canvas audio video datalist title meta link base param source track colgroup col area annotation annotation-xml noframes noembed".split())
BLOCK = frozenset("address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary ul table caption".split())
SPACED = frozenset("blockquote dl fieldset figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
#: A start tag of the key ends open elements of these names, looked for up to the nearest of the stops.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "option": ({"option"}, {"select", "datalist"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "tr": ({"tr", "td", "th", "caption"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption"}, {"table"}),
    "body": ({"head"}, set()),
}
#: Start tags that leave an open head, and an open colgroup, open. Any other, or text, ends it.
IN_HEAD = frozenset("html head base basefont bgsound link meta title noscript noframes style script template".split())
IN_COLGROUP = frozenset("html col template".split())
#: Children of a head or colgroup whose own content is not looked at.
_INNER = frozenset("title noscript noframes style script template".split())
#: These end an open paragraph; a paragraph is looked for up to the nearest of the stops.
ENDS_P = BLOCK - {"body", "html", "option", "optgroup", "legend", "caption"}
P_STOPS = {"button", "td", "th", "caption", "table", "object"}
#: Text in an svg shows in these alone, and not at all in those.
SVG_TEXT = frozenset("text foreignobject".split())
SVG_NOT_SHOWN = frozenset("defs symbol clippath mask pattern marker desc metadata".split())
#: A table is aligned if that makes it at most so many times as long as its text, and so many characters longer. Any other (few texts in very many
#: columns, say) is set without alignment, so a page's text is never much longer than the page.
MOST_TIMES, MOST_MORE = 64, 1 << 16
#: Lists and quotes inside more than so many others are indented no further; tables inside more than so many others are set as blocks.
DEEPEST, DEEPEST_TABLE = 64, 32
_SPACE = re.compile(r"[ \t\n\r\f]+")
_NONE = re.compile(r"display\s*:\s*none", re.I)
_VISIBILITY = re.compile(r"visibility\s*:\s*(hidden|collapse|visible)", re.I)


class Node:
    __slots__ = ("tag", "attrs", "children")

    def __init__(self, tag: str, attrs: dict):
        self.tag, self.attrs, self.children = tag, attrs, []


_NAME = re.compile(r"[^\t\n\f\r />]+")
_BEFORE_NAME = re.compile(r"[\t\n\f\r /]*")
_ATTRIBUTE = re.compile(r"=?[^\t\n\f\r />=]*")
_EQUALS = re.compile(r"[\t\n\f\r ]*=[\t\n\f\r ]*")
_BARE = re.compile(r"[^\t\n\f\r >]*")
#: Elements whose content is text up to their own end tag; character references count in those of the second set.
_RAW = frozenset("script style xmp iframe noembed noframes".split())
_RAW_WITH_REFERENCES = frozenset("title textarea".split())
_RAW_END = {name: re.compile(rf"</{name}(?=[\t\n\f\r />])", re.I) for name in _RAW | _RAW_WITH_REFERENCES}


def _tag(html: str, at: int) -> tuple[int, str, dict, bool]:
    """A tag whose name starts at `at`: where it ends, name, attributes (the first of a name counts), whether it closes itself.
    The end is -1 if the page ends in it."""
    m = _NAME.match(html, at)
    name, at, attrs = m[0].lower(), m.end(), {}
    while True:
        skipped = _BEFORE_NAME.match(html, at)
        at = skipped.end()
        if at >= len(html):
            return -1, name, attrs, False
        if html[at] == ">":
            return at + 1, name, attrs, html[at - 1] == "/"
        m = _ATTRIBUTE.match(html, at)
        key, at, value = m[0].lower(), m.end(), ""
        if m := _EQUALS.match(html, at):
            at = m.end()
            quote = html[at : at + 1]
            if quote in ("'", '"') and quote:
                end = html.find(quote, at + 1)
                if end < 0:
                    return -1, name, attrs, False
                value, at = html[at + 1 : end], end + 1
            else:
                m = _BARE.match(html, at)
                value, at = m[0], m.end()
        attrs.setdefault(key, unescape(value) if "&" in value else value)


def tokens(html: str) -> Iterator[tuple[str, str, dict | None]]:
    """("text", text, None), ("start", name, attributes), ("self", name, attributes) or ("end", name, None), as the HTML standard cuts a page,
    errors included: any text is a page. Each character is looked at a fixed number of times, so time follows the length.

    What the page's end cuts short (a tag, a comment) is dropped, as browsers do; raw text without its end tag runs to the end.
    """
    at, size, embedded = 0, len(html), 0
    while at < size:
        lt = html.find("<", at)
        if lt < 0:
            lt = size
        if lt > at:
            text = html[at:lt]
            yield "text", unescape(text) if "&" in text else text, None
            at = lt
            continue
        head = html[at + 1 : at + 2]
        if head.isascii() and head.isalpha():
            end, name, attrs, closed = _tag(html, at + 1)
            if end < 0:
                return
            yield ("self" if closed else "start"), name, attrs
            at = end
            if name in ("svg", "math") and not closed:
                embedded += 1
            if name == "plaintext":
                yield "text", html[at:], None
                return
            if name in _RAW_END and not embedded:
                m = _RAW_END[name].search(html, at)
                end = m.start() if m else size
                if end > at:
                    text = html[at:end]
                    yield "text", unescape(text) if name in _RAW_WITH_REFERENCES else text, None
                at = end
        elif head == "/" and (c := html[at + 2 : at + 3]).isascii() and c.isalpha():
            end, name, _, _ = _tag(html, at + 2)
            if end < 0:
                return
            if name in ("svg", "math"):
                embedded = max(0, embedded - 1)
            yield "end", name, None
            at = end
        elif html.startswith("<!--", at):
            if html.startswith(">", at + 4) or html.startswith("->", at + 4):
                at = html.index(">", at) + 1
                continue
            m = _COMMENT_END.search(html, at + 4)
            if not m:
                return
            at = m.end()
        elif embedded and html.startswith("<![CDATA[", at):
            end = html.find("]]>", at)
            yield "text", html[at + 9 : size if end < 0 else end], None
            if end < 0:
                return
            at = end + 3
        elif head in ("!", "?", "/") and head:
            end = html.find(">", at)
            if end < 0:
                return
            at = end + 1
        else:
            yield "text", "<", None
            at += 1


_COMMENT_END = re.compile("--!?>")
_TABLE_PARTS = frozenset("caption colgroup col tbody thead tfoot tr td th".split())
#: Where only parts of a table may stand: text and other elements found here are moved before the table.
_IN_TABLE = frozenset("table thead tbody tfoot tr".split())
_STAY_IN_TABLE = _TABLE_PARTS | frozenset("table style script template".split())
_CELLS = frozenset("table td th".split())


class _Builder:
    def __init__(self):
        self.root = Node("#root", {})
        self.open = [self.root]
        #: Where the open elements of a name are, so that none has to be searched for.
        self.at: dict[str, list[int]] = {}

    def _push(self, tag: str, attrs: dict, parent: Node | None = None) -> None:
        node = Node(tag, attrs)
        if parent is None:
            self.open[-1].children.append(node)
        else:
            parent.children.insert(len(parent.children) - 1, node)
        self.at.setdefault(tag, []).append(len(self.open))
        self.open.append(node)

    def _pop_to(self, k: int) -> None:
        for node in reversed(self.open[k:]):
            self.at[node.tag].pop()
        del self.open[k:]

    def _nearest(self, names) -> int:
        """Where the innermost open element of these names is; 0 if none is."""
        return max((self.at[n][-1] for n in names if self.at.get(n)), default=0)

    def _end(self, names, stops) -> None:
        """Closes open elements from the outermost of `names` inside the nearest of `stops`."""
        stop, found = self._nearest(stops), None
        for n in names:
            places = self.at.get(n)
            if places and places[-1] > stop:
                k = places[bisect_right(places, stop)]
                found = k if found is None else min(found, k)
        if found:
            self._pop_to(found)

    def _leave(self, tag: str) -> None:
        """Closes an open head or colgroup where a start tag, or text for an empty name, may not stand in it. In what it may hold, anything may stand."""
        for name, held in (("colgroup", IN_COLGROUP), ("head", IN_HEAD)):
            if self.at.get(name) and tag not in held and self._nearest(_INNER) < self.at[name][-1]:
                self._pop_to(self.at[name][-1])

    def _before_table(self) -> Node | None:
        """The element that holds the table, if what comes now stands between the table's parts."""
        return self.open[self.at["table"][-1] - 1] if self.open[-1].tag in _IN_TABLE and self.at.get("table") else None

    def start(self, tag: str, attrs: dict) -> None:
        self._leave(tag)
        if tag in ENDS:
            self._end(*ENDS[tag])
        if tag in ENDS_P:
            self._end({"p"}, P_STOPS)
        if tag in _TABLE_PARTS and (k := self._nearest(_IN_TABLE | _CELLS | {"caption"})) and self.open[k].tag in _IN_TABLE:
            self._pop_to(k + 1)
        if tag in ("td", "th") and self.at.get("table") and self.open[-1].tag in ("table", "thead", "tbody", "tfoot"):
            self._push("tr", {})
        parent = None if tag in _STAY_IN_TABLE else self._before_table()
        if tag in VOID:
            into = self.open[-1].children if parent is None else parent.children
            into.insert(len(into) - (parent is not None), Node(tag, attrs))
        else:
            self._push(tag, attrs, parent)

    def self_closed(self, tag: str, attrs: dict) -> None:
        self.start(tag, attrs)
        if self.open[-1].tag == tag and (self.at.get("svg") or self.at.get("math")):
            self._pop_to(len(self.open) - 1)

    def end(self, tag: str) -> None:
        if tag == "br":
            self.open[-1].children.append(Node("br", {}))
        if not self.at.get(tag):
            if tag == "p":
                self._push("p", {})
                self._pop_to(len(self.open) - 1)
            return
        k = self.at[tag][-1]
        if tag in ("table", "tr", "thead", "tbody", "tfoot", "td", "th", "body", "html") or self._nearest(_CELLS) < k:
            self._pop_to(k)

    def text(self, data: str) -> None:
        parent = None
        if data.strip(" \t\n\r\f"):
            self._leave("")
            parent = self._before_table()
        into = self.open[-1].children if parent is None else parent.children
        into.insert(len(into) - (parent is not None), data)


def tree(html: str) -> Node:
    b = _Builder()
    for kind, value, attrs in tokens(html):
        if kind == "text":
            b.text(value)
        elif kind == "start":
            b.start(value, attrs)
        elif kind == "end":
            b.end(value)
        else:
            b.self_closed(value, attrs)
    return b.root


class _Page:
    """Lines as they are laid out. gap: line ends owed before the next text (1: a new line, 2: a blank one)."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.indent: list[str] = []
        self.mark = ""
        self.space = False
        self.gap = 0

    def _flush(self) -> None:
        if self.line:
            self.lines.append("".join(self.line).rstrip())
            self.line = []
        self.space = False

    def block(self, spaced: bool) -> None:
        self._flush()
        self.gap = max(self.gap, 2 if spaced else 1)

    def _begin(self) -> None:
        if self.gap == 2 and self.lines and self.lines[-1]:
            self.lines.append("")
        self.gap = 0
        lead = "".join(self.indent[:DEEPEST])
        if self.mark:
            lead = "".join(self.indent[: min(DEEPEST, len(self.indent) - 1)]) + self.mark
            self.mark = ""
        self.line.append(lead)

    def text(self, data: str) -> None:
        words = _SPACE.split(data)
        if words == [""]:
            return
        if not words[0]:
            self.space = True
        inner = " ".join(w for w in words if w)
        if inner:
            if not self.line:
                self._begin()
            elif self.space:
                self.line.append(" ")
            self.line.append(inner)
            self.space = not words[-1]

    def raw(self, data: str) -> None:
        first, *rest = data.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        for k, part in enumerate([first, *rest]):
            if k:
                if not self.line:
                    self._begin()
                self._flush()
            if part:
                if not self.line:
                    self._begin()
                self.line.append(part)

    def newline(self) -> None:
        if self.line:
            self._flush()
        elif not self.gap and self.lines and self.lines[-1]:
            self.lines.append("")

    def whole(self, lines: list[str]) -> None:
        for x in lines:
            self._begin()
            self.line.append(x)
            self._flush()

    def done(self) -> list[str]:
        self._flush()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class _Columns:
    """Until which row each column is taken by cells from above. Columns are halves of halves of a range that grows; a half knows the least row of its columns, so both
    taking columns and finding the next free one cost steps as the logarithm of the columns, however many cells reach down however far."""

    def __init__(self):
        self.height = 0
        self.least: dict[tuple[int, int], int] = {}
        self.all: dict[tuple[int, int], int] = {}

    def take(self, start: int, end: int, row: int) -> None:
        """Columns [start, end) are taken before `row`."""
        while end > 1 << self.height:
            self.height += 1
        self._take(self.height, 0, start, end, row)

    def _take(self, k: int, i: int, start: int, end: int, row: int) -> None:
        first, last = i << k, (i + 1) << k
        if end <= first or last <= start or self.least.get((k, i), 0) >= row:
            return
        if start <= first and last <= end:
            self.least[k, i] = self.all[k, i] = row
            return
        self._take(k - 1, 2 * i, start, end, row)
        self._take(k - 1, 2 * i + 1, start, end, row)
        self.least[k, i] = max(self.all.get((k, i), 0), min(self.least.get((k - 1, 2 * i), 0), self.least.get((k - 1, 2 * i + 1), 0)))

    def free(self, start: int, row: int) -> int:
        """The first column from `start` on that is free in `row`."""
        if not self.least:
            return start
        found = self._free(self.height, 0, start, row)
        return max(start, 1 << self.height) if found is None else found

    def _free(self, k: int, i: int, start: int, row: int) -> int | None:
        if (i + 1) << k <= start or self.least.get((k, i), 0) > row:
            return None
        if (k, i) not in self.least or not k:
            return max(start, i << k)
        found = self._free(k - 1, 2 * i, start, row)
        return self._free(k - 1, 2 * i + 1, start, row) if found is None else found


class _Table:
    def __init__(self):
        self.rows: list[dict[int, list[str]]] = []
        self.taken = _Columns()
        self.at = 0

    def row(self) -> None:
        self.at = 0
        self.rows.append({})

    def cell(self, lines: list[str], across: int, down: int) -> None:
        """A cell of one line or more, at the next place that no cell from above takes."""
        if not self.rows:
            self.row()
        here = len(self.rows) - 1
        self.at = self.taken.free(self.at, here)
        if lines:
            self.rows[-1][self.at] = lines
        if down > 1:
            self.taken.take(self.at, self.at + across, here + down)
        self.at += across

    def lines(self) -> list[str]:
        """Cells side by side, each column as wide as its widest line, each row as high as its highest cell."""
        rows = [r for r in self.rows if r]
        width: dict[int, int] = {}
        for r in rows:
            for c, x in r.items():
                width[c] = max(width.get(c, 0), max(map(len, x)))
        columns = sorted(width)
        start, total = {}, 0
        for c in columns:
            start[c], total = total, total + width[c] + 2
        text = sum(len(x) for r in rows for cell in r.values() for x in cell)
        if sum(max(start[c] * len(x) for c, x in r.items()) for r in rows) > MOST_TIMES * text + MOST_MORE:
            return ["  ".join(" ".join(r[c]) for c in sorted(r)) for r in rows]
        out = []
        for r in rows:
            cells = sorted(r.items())
            for k in range(max(len(x) for _, x in cells)):
                line, at = [], 0
                for c, x in cells:
                    if k < len(x) and x[k]:
                        line.append(" " * (start[c] - at) + x[k])
                        at = start[c] + len(x[k])
                out.append("".join(line))
        return out


def _number(value, default: int, most: int) -> int:
    """A whole number from an attribute, from 1 to most."""
    m = re.match(r"\s*\+?(\d{1,9})", value or "")
    return min(max(int(m[1]), 1), most) if m else default


def _shown(node: Node, visible: bool) -> tuple[bool, bool]:
    """Whether an element makes boxes, and whether text in it is visible."""
    a = node.attrs
    style = a.get("style") or ""
    if node.tag in NOT_SHOWN or "hidden" in a or _NONE.search(style) or node.tag == "input" or node.tag == "dialog" and "open" not in a:
        return False, False
    if m := _VISIBILITY.search(style):
        visible = m[1].lower() == "visible"
    return True, visible


def render(html: str | None) -> str:
    """The visible text of a page.

    Not shown: what browsers don't lay out (head, script, style, template, fallback content, form inputs), elements with
    `hidden`, display:none or visibility:hidden in their style attribute (an inner visibility:visible shows again), closed dialogs, all of a closed details but
    its summary, and comments. An svg shows its text elements, a formula its text in order. Style sheets aren't applied. Blocks start new lines, paragraphs and the like are set off by
    blank lines, list items carry a dash or their number and are indented by depth, cells are aligned by column, pre keeps its
    spaces. Text and elements between a table's parts go before the table, as in browsers. A cell keeps its lines; cells stand side by side.
    The walk keeps its own stack, so depth has no limit, and time follows the page's length. None or an empty page gives an empty text.
    """
    if not html:
        return ""
    page = _Page()
    pages, tables, lists, deeper = [page], [], [], 0
    todo: list = [("in", tree(html), True, False)]
    while todo:
        what, node, visible, pre = todo.pop()
        page = pages[-1]
        if what == "in":
            if isinstance(node, str):
                if visible and pre != "svg":
                    (page.raw if pre else page.text)(node)
                continue
            tag = node.tag
            shown, visible = (True, visible) if tag == "#root" else _shown(node, visible)
            if not shown:
                continue
            if tag == "br":
                page.newline()
                continue
            if tag == "wbr":
                continue
            children = node.children
            if tag == "details" and "open" not in node.attrs:
                children = [c for c in children if isinstance(c, Node) and c.tag == "summary"][:1]
            if tag == "svg":
                pre = "svg"
            elif pre == "svg":
                if tag in SVG_NOT_SHOWN or node.attrs.get("display") == "none":
                    continue
                if tag in SVG_TEXT:
                    pre, children = False, [" ", *children, " "]
            else:
                pre = pre or tag in ("pre", "textarea", "listing", "xmp")
            if tag == "mfrac":
                children = [x for c in children for x in (c, " ")]
            elif tag == "mtd":
                children = [*children, " "]
            if tag == "table" and len(tables) < DEEPEST_TABLE:
                page.block(True)
                tables.append(_Table())
            elif tag == "table":
                deeper += 1
                page.block(False)
            elif tag in ("tr", "td", "th", "caption") and deeper:
                page.block(False)
            elif tag == "tr" and tables:
                tables[-1].row()
            elif tag in ("td", "th", "caption") and tables:
                pages.append(_Page())
            elif tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and lists))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.append(_number(node.attrs.get("start"), 1, 10**9) if tag == "ol" else None)
            elif tag == "li":
                if lists and lists[-1] is not None:
                    n = _number(node.attrs.get("value"), lists[-1], 10**9)
                    page.mark, lists[-1] = f"{n}. ", n + 1
                else:
                    page.mark = "- "
                page.indent.append(" " * len(page.mark))
            elif tag in ("dd", "blockquote"):
                page.indent.append("  ")
            todo.append(("out", node, visible, pre))
            todo.extend(("in", c, visible, pre) for c in reversed(children))
        else:
            tag = node.tag
            if tag == "table" and not deeper:
                lines = tables.pop().lines()
                page.whole(lines)
                page.block(True)
            elif tag == "table":
                deeper -= 1
                page.block(False)
            elif tag in ("tr", "td", "th", "caption") and deeper:
                page.block(False)
            elif tag in ("td", "th") and tables:
                lines = [x for x in pages.pop().done() if x.strip()]
                across, down = _number(node.attrs.get("colspan"), 1, 1000), _number(node.attrs.get("rowspan"), 1, 65534)
                tables[-1].cell(lines, across, down)
            elif tag == "caption" and tables:
                lines = pages.pop().done()
                pages[-1].whole(lines)
            elif tag == "li" or tag in ("dd", "blockquote"):
                page.block(tag == "blockquote")
                page.indent.pop()
                page.mark = "" if tag == "li" else page.mark
            elif tag in BLOCK:
                page.block(tag in SPACED and not (tag in ("ul", "ol", "menu", "dir") and len(lists) > 1))
            if tag in ("ul", "ol", "menu", "dir"):
                lists.pop()
    return "\n".join(pages[0].done())


def extract_text(df: DataFrame, html_col: str = "html", out_col: str = "text") -> DataFrame:
    """df with out_col, the visible text of html_col (null for null). Each row alone, so nothing is shuffled. All columns are kept;
    one that has out_col's name is replaced."""
    kept = [c for c in df.columns if c != out_col]

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for b in batches:
            yield pd.Series([None if x is None else render(x) for x in b], dtype=object)

    text = F.pandas_udf(run, "string")
    return df.select(*(F.col(f"`{c}`") for c in kept), text(F.col(html_col)).alias(out_col))


def op10_html_text(spark, sf_dir: str) -> DataFrame:
    """Every page with its visible text."""
    return extract_text(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))
