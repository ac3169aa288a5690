"""Layout-aware text of web pages: a tree builder with implied tags, visibility rules, and a renderer.

The renderer emits all visible text: blocks on lines of their own with blank lines between paragraphs,
list items with bullets or numbers and indented by depth, preformatted text as it is, and table cells
padded so that columns align.  Pages are worked on one by one in Arrow batches; no page meets another.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
HIDDEN = frozenset("head script style template noscript iframe object audio video canvas svg math datalist".split())
RAW = frozenset("script style textarea title noscript iframe template".split())
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu table blockquote pre figure article section form fieldset".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body div main header footer nav aside address li dt dd tr caption figcaption details summary center legend hgroup option".split())
#: a start tag of the first kind ends open elements of the second, up to one of the third
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}), "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "caption"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "tbody": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "thead": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "caption", "colgroup"}, {"table"}), "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}), "body": ({"head"}, {"html"}),
}
SCOPE = frozenset("html table td th caption button object".split())
MAX_SPAN = 1000          # of a table cell, as browsers have it
MAX_DEPTH = 512          # of open elements, as browsers have it; deeper ones become siblings
MAX_TABLES = 40          # nested tables that keep their columns; deeper ones become running text

TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>|<[!?/][^>]*>|[^<]+|<", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
UNSEEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse)")
BLANKS = re.compile(r"[ \t\n\r\f]+")


class Node:
    __slots__ = ("attributes", "children", "tag")

    def __init__(self, tag: str, attributes: dict | None = None):
        self.tag, self.attributes, self.children = tag, attributes or {}, []


def _attributes(text: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in ATTRIBUTE.findall(text):
        out.setdefault(name.lower(), unescape(a or b or c))
    return out


def parse(html: str) -> Node:
    """Tree of elements and strings.  Unclosed and stray tags never fail: what they imply is opened or closed."""
    root = Node("html")
    stack, at, n = [root], 0, len(html)
    while at < n:
        m = TOKEN.match(html, at)
        at = m.end()
        tag = m[2]
        if tag is None:
            text = m[0]
            if text[0] != "<" or text == "<":
                stack[-1].children.append(unescape(text))
            continue
        tag = tag.lower()
        if m[1]:
            _close(stack, tag)
            continue
        if tag == "html":
            continue
        if tag in CLOSES:
            ends, limits = CLOSES[tag]
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].tag in ends:
                    del stack[k:]
                    break
                if stack[k].tag in limits:
                    break
            if tag in ("td", "th") and stack[-1].tag != "tr" and any(x.tag == "table" for x in stack):
                _open(stack, Node("tr"))
        elif tag in BLOCKS:
            if len(stack) > 1 and stack[-1].tag == "head":
                stack.pop()
            for k in range(len(stack) - 1, 0, -1):     # a block ends an open paragraph
                if stack[k].tag == "p":
                    del stack[k:]
                    break
                if stack[k].tag in SCOPE:
                    break
        node = Node(tag, _attributes(m[3]) if m[3].strip(" /\n\t") else None)
        if tag in VOID or m[3].endswith("/") and tag not in BLOCKS and tag not in RAW:
            stack[-1].children.append(node)
        elif tag in RAW:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?|\Z", re.I).search(html, at)
            node.children.append(unescape(html[at:end.start()]))
            at = end.end()
            stack[-1].children.append(node)
        else:
            _open(stack, node)
    return root


def _open(stack: list[Node], node: Node) -> None:
    stack[-1].children.append(node)
    if len(stack) < MAX_DEPTH:
        stack.append(node)


def _close(stack: list[Node], tag: str) -> None:
    if tag == "br":
        stack[-1].children.append(Node("br"))
        return
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].tag == tag:
            del stack[k:]
            return
        if stack[k].tag in ("table", "td", "th") and tag not in ("table", "tr", "tbody", "thead", "tfoot", "body"):
            return


def visible(node: Node) -> bool:
    a = node.attributes
    if node.tag in HIDDEN or node.tag == "title":
        return False
    return not a or not ("hidden" in a or node.tag == "input" or "style" in a and UNSEEN.search(a["style"].lower()))


class _Page:
    """Lines of one page or table cell."""

    def __init__(self):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.blank = False
        self.lead = ""

    def text(self, text: str, indent: str) -> None:
        lead = text[0] in " \t\n\r\f"
        words = BLANKS.sub(" ", text).strip(" ")
        if not words:
            self.space |= bool(self.line)
            return
        if not self.line:
            if self.blank and self.lines:
                self.lines.append("")
            self.blank = False
            self.line.append(indent + self.lead if self.lead else indent)
            self.lead = ""
        elif lead or self.space:
            self.line.append(" ")
        self.line.append(words)
        self.space = text[-1] in " \t\n\r\f"

    def whole(self, lines: list[str], indent: str) -> None:
        self.stop()
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        for x in lines:
            self.lines.append((indent + self.lead + x).rstrip())
            self.lead = ""

    def stop(self, paragraph: bool = False) -> None:
        if self.line:
            self.lines.append("".join(self.line))
            self.line = []
        self.space = False
        self.blank |= paragraph

    def newline(self) -> None:
        if self.line:
            self.stop()
        elif self.lines and self.lines[-1]:
            self.lines.append("")


def render(root: Node, depth: int = 0) -> str:
    """Visible text of a tree."""
    page = _Page()
    work: list[tuple] = [(root, "", 0)]      # (node or string, indent, list depth), or (None, is paragraph, ended list)
    counters: list[list] = []
    while work:
        node, indent, level = work.pop()
        if node is None:
            page.stop(indent)
            if level:
                counters.pop()
            continue
        if isinstance(node, str):
            page.text(node, indent) if node else None
            continue
        tag = node.tag
        if not visible(node):
            continue
        if tag == "br":
            page.newline()
            continue
        if tag == "hr":
            page.whole(["---"], indent)
            continue
        if tag == "table":
            page.stop(True)
            if depth < MAX_TABLES:
                page.whole(_table(node, depth + 1), indent)
                page.blank = True
                continue
        if tag == "pre":
            page.stop(True)
            page.whole(_plain(node).strip("\n").expandtabs(8).split("\n"), indent)
            page.blank = True
            continue
        block = tag in BLOCKS
        inner, ended = indent, 0
        if block:
            nested = tag in ("ul", "ol", "menu") and level > 0
            page.stop(tag in PARAGRAPHS and not nested)
            if tag in ("ul", "ol", "menu"):
                start = node.attributes.get("start", "1")
                counters.append([int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1, tag == "ol"])
                inner, ended, level = indent + ("  " if level else ""), 1, level + 1
            elif tag == "li":
                if counters and counters[-1][1]:
                    page.lead = f"{counters[-1][0]}. "
                    counters[-1][0] += 1
                else:
                    page.lead = "- "
            elif tag in ("blockquote", "dd"):
                inner = indent + "  "
            work.append((None, tag in PARAGRAPHS and not nested, ended))
        elif tag in ("td", "th"):
            page.text(" ", indent)
        work.extend((child, inner, level) for child in reversed(node.children))
    page.stop()
    return "\n".join(page.lines)


def _plain(node: Node) -> str:
    out, work = [], [node]
    while work:
        x = work.pop()
        if isinstance(x, str):
            out.append(x)
        elif x.tag == "br":
            out.append("\n")
        elif x is node or visible(x):
            work.extend(reversed(x.children))
    return "".join(out).replace("\r\n", "\n")


def _span(node: Node, name: str) -> int:
    value = node.attributes.get(name, "1")
    return min(MAX_SPAN, int(value)) if re.fullmatch(r"0*[1-9]\d{0,8}", value) else 1


def _table(table: Node, depth: int) -> list[str]:
    """Lines of a table: caption, then rows with cells padded to the width of their column."""
    out, rows, work = [], [], list(reversed(table.children))
    while work:
        x = work.pop()
        if isinstance(x, str):
            if x.strip():
                out.append(BLANKS.sub(" ", x).strip())
        elif not visible(x):
            continue
        elif x.tag == "tr":
            rows.append([c for c in x.children if isinstance(c, Node) and c.tag in ("td", "th") and visible(c)])
            loose = [c for c in x.children if not (isinstance(c, Node) and c.tag in ("td", "th"))]
            work.extend(c for c in reversed(loose) if isinstance(c, Node) or c.strip())
        elif x.tag in ("thead", "tbody", "tfoot"):
            work.extend(reversed(x.children))
        else:
            cell = Node("div")
            cell.children = [x]
            out.extend(y for y in render(cell, depth).split("\n") if y)
    grid: list[list[list[str]]] = []
    held: dict[int, int] = {}            # column -> rows that a cell from above still covers
    for cells in rows:
        line, column = [], 0
        def skip(line=line):
            while held.get(len(line), 0):
                held[len(line)] -= 1
                line.append([""])
        for c in cells:
            skip()
            inner = Node("div")
            inner.children = c.children
            text = [y.strip() if i else y for i, y in enumerate(render(inner, depth).split("\n")) if y] or [""]
            column = len(line)
            line.append(text)
            wide, tall = _span(c, "colspan"), _span(c, "rowspan")
            line.extend([[""]] * (wide - 1))
            if tall > 1:
                held.update({k: tall - 1 for k in range(column, column + wide)})
        skip()
        grid.append(line)
    widths: list[int] = []
    for line in grid:
        for k, cell in enumerate(line):
            size = max(map(len, cell))
            if k == len(widths):
                widths.append(size)
            elif size > widths[k]:
                widths[k] = size
    for line in grid:
        for k in range(max((len(c) for c in line), default=0)):
            out.append("  ".join((c[k] if k < len(c) else "").ljust(w) for c, w in zip(line, widths, strict=False)).rstrip())
    return [x for x in out if x]


def extract(html: str | None) -> str | None:
    """Visible text of a page; null for null, empty for pages without any."""
    return None if html is None else render(parse(html))


def with_text(pages: DataFrame, html_col: str = "html", out: str = "visible_text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all if None) plus ``out``, row for row."""
    carry = pages.columns if carry is None else carry
    if out in carry:
        raise ValueError(f"column {out} exists; give another name")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                text = pa.array([extract(x) for x in part.column(html_col).to_pylist()], pa.string())
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in carry), text], [*carry, out])

    return pages.mapInArrow(run, StructType([pages.schema[c] for c in carry]).add(out, "string"))
