"""Operator 7: visible text of HTML pages, laid out.

A small tree builder (implied end tags, void and raw-text elements) makes the nodes; visibility
rules drop what a browser does not show (of svg it shows text and foreignObject; all options of a select
count as shown); the renderer keeps block spacing (one line break between
blocks, a blank line around paragraphs, headings, lists and tables), nested list markers, preformatted
text and table cells aligned in columns. ``visibility`` is inherited and may be turned on again below; of a closed
``details`` only the summary shows; cells that span columns or rows keep the others in their columns.

Spark reads, splits and writes; a page is handled on its own, so memory is bounded by one page. Time is linear in the
page, whatever its nesting: open elements are looked up by tag. For that, lists deeper than ``DEEP`` levels are not
indented further, tables deeper than that are laid out as blocks, and a table whose aligned form would be more than
``SPREAD`` times its text has its cells two spaces apart instead; no text is lost by that.

Defined cases: null html gives null text, empty html the empty text; unclosed and misnested tags,
stray '<' and unknown entities are kept as text or closed by the rules; a tag without '>' ends at the next '<', and
is text if there is none; nesting of any depth works (no recursion); repeated rows are rendered alike; other columns
are ignored.
"""

from __future__ import annotations

import re
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())
UNSEEN = frozenset("script style head title template noscript meta link base datalist iframe object audio video "
                   "canvas noembed noframes".split())
BLOCK = frozenset("address article aside blockquote body center details dialog dd div dl dt fieldset figcaption figure "
                  "footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol p pre section summary "
                  "table tbody td tfoot th thead tr ul caption".split())
#: elements of svg whose text is shown
DRAWN = frozenset({"text", "foreignobject"})
#: shown on lines of their own, though they are no blocks to the tree
LINES = DRAWN | {"option", "optgroup", "select"}
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl blockquote pre table figure menu".split())
#: a start tag closes these open elements, up to the nearest of the barriers
CLOSES = {
    **{t: ({"p"}, {"table", "td", "th", "button", "body"}) for t in BLOCK - {"td", "th", "tr", "tbody", "thead", "tfoot",
                                                                           "caption", "html", "body", "li", "dt", "dd"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd", "p"}, {"dl"}), "dd": ({"dt", "dd", "p"}, {"dl"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}), "th": ({"td", "th", "p"}, {"tr", "table"}),
    "tr": ({"tr", "td", "th", "caption", "p"}, {"table"}),
    **{t: ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "p"}, {"table"}) for t in ("tbody", "thead", "tfoot")},
    "body": ({"head"}, {"html"}), "option": ({"option"}, {"select"}), "optgroup": ({"option"}, {"select"}),
}
#: start tags that leave an open head open; any other, and text, ends it
HEAD = frozenset("title meta link base basefont bgsound script style noscript noframes template head html".split())
#: an end tag does not reach past these
WALL = frozenset({"table", "td", "th", "body"})
TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*(?:>|\Z)"
                   r"|<(/?)([a-zA-Z][^\s/><]*+)((?:[^<>\"']|\"[^\"]*\"|'[^']*')*+[\"']?)(?:>|(?=<))", re.S)
ATTRIBUTE = re.compile(r"([^\s=/\"'<>]+)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s\"'>]+))?")
NONE = re.compile(r"display\s*:\s*none", re.I)
VISIBILITY = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
DEEP = 32
SPREAD = 32
#: rows of a table are their own to the tree
ROWS = frozenset({"tr", "tbody", "thead", "tfoot"})
SEVERAL = ROWS | {"li", "dt", "dd", "td", "th"}


class Node:
    """``svg`` is whether the node is inside svg, ``drawn`` whether text right in it is shown there, ``shown`` whether
    it is visible, ``span`` the columns and rows of a cell."""
    __slots__ = ("tag", "hidden", "start", "children", "svg", "drawn", "shown", "span")

    def __init__(self, tag: str, hidden: bool = False, start: int = 1):
        self.tag, self.hidden, self.start, self.children, self.svg, self.drawn = tag, hidden, start, [], False, True
        self.shown, self.span = True, (1, 1)


def _number(text: str | None, most: int) -> int:
    return max(1, min(int(text), most)) if text and re.fullmatch(r"\d{1,9}", text) else 1


def _node(tag: str, raw: str, held: Node) -> Node:
    node = Node(tag, tag in UNSEEN)
    node.shown = held.shown
    attrs = {}
    if raw and not raw.isspace():
        attrs = {m[1].lower(): unescape((m[2] or "").strip("\"'")) for m in ATTRIBUTE.finditer(raw)}
        style = attrs.get("style", "")
        node.hidden = (node.hidden or "hidden" in attrs or bool(NONE.search(style)) or tag == "dialog" and "open" not in attrs)
        for m in VISIBILITY.finditer(style):
            node.shown = m[1].lower() == "visible"
        if tag == "ol" and re.fullmatch(r"-?\d{1,9}", attrs.get("start", "")):
            node.start = int(attrs["start"])
        if tag in ("td", "th"):
            node.span = _number(attrs.get("colspan"), 1000), _number(attrs.get("rowspan"), 65534)
        if tag == "optgroup" and attrs.get("label") and node.shown:
            label = Node("option")
            label.children.append(attrs["label"])
            node.children.append(label)
    if tag == "details" and "open" not in attrs:
        node.start = 0   # closed
    return node


class Open:
    """The open elements, with the places of each tag, so that the nearest of a tag is found at once."""

    def __init__(self, root: Node):
        self.stack, self.places = [root], {}

    def push(self, node: Node):
        self.places.setdefault(node.tag, []).append(len(self.stack))
        self.stack.append(node)

    def cut(self, k: int):
        """Close the element at place ``k`` and all inside it."""
        while len(self.stack) > k:
            self.places[self.stack.pop().tag].pop()

    def nearest(self, tags) -> int:
        """Place of the innermost open element of these tags; 0 if there is none."""
        return max((self.places[t][-1] for t in tags if self.places.get(t)), default=0)

    def end_head(self):
        """Close an open head, unless something that holds its own content is open in it."""
        if self.stack[-1].tag == "head":
            self.cut(len(self.stack) - 1)


def _closed_itself(raw: str) -> bool:
    """Whether attributes end in a slash that is no part of an unquoted value."""
    if not raw.endswith("/"):
        return False
    last = re.split(r"[\s\"'>]", raw)[-1]
    return "=" not in last and not raw[:len(raw) - len(last)].rstrip().endswith("=")


def build(html: str) -> Node:
    """The page as a tree; children are nodes and strings."""
    root = Node("#root")
    opened, at = Open(root), 0
    stack = opened.stack
    while at < len(html):
        m = TOKEN.search(html, at)
        text = html[at:m.start() if m else len(html)]
        if text:
            if not text.isspace():
                opened.end_head()
            if stack[-1].drawn and stack[-1].shown:
                stack[-1].children.append(unescape(text) if "&" in text else text)
        if not m:
            break
        at = m.end()
        if m[2] is None:
            continue
        tag = m[2].lower()
        if m[1]:
            k = opened.nearest((tag,))
            if k and (tag in WALL or tag in ROWS or tag == "html" or k > opened.nearest(WALL)):
                opened.cut(k)
            continue
        if tag not in HEAD:
            opened.end_head()
        if tag in CLOSES:
            gone, barrier = CLOSES[tag]
            wall = opened.nearest(barrier)
            while (k := opened.nearest(gone)) > wall:
                opened.cut(k)
                if tag not in SEVERAL:
                    break
        held = stack[-1]
        node = _node(tag, m[3], held)
        held.children.append(node)
        node.svg = held.svg or tag == "svg"
        node.drawn = tag in DRAWN or held.drawn and tag != "svg"
        node.hidden = node.hidden or held.svg and tag in ("desc", "metadata")
        if node.svg and tag not in VOID and _closed_itself(m[3]):
            continue
        if tag in RAW:
            close = re.compile(rf"</{tag}\s*>", re.I).search(html, at)
            stop = close.start() if close else len(html)
            if node.shown:
                node.children.append(unescape(html[at:stop]) if tag == "textarea" else html[at:stop])
            at = close.end() if close else len(html)
        elif tag not in VOID:
            opened.push(node)
    return root


class Page:
    """Lines of output: inline text gathers in ``words`` until a break ends the line."""

    def __init__(self):
        self.lines, self.words, self.blank, self.indent, self.marker = [], [], False, 0, ""

    def text(self, s: str, pre: bool):
        if pre:
            first, *rest = s.replace("\r\n", "\n").split("\n")
            self.words.append(first)
            for line in rest:
                self.newline(force=True, pre=True)
                self.words.append(line)
        else:
            self.words.append(s)

    def newline(self, force: bool = False, pre: bool = False):
        line = "".join(self.words)
        line = line.rstrip() if pre else " ".join(line.split())
        self.words = []
        if line or force and (pre or not self.marker):
            if self.blank and self.lines:
                self.lines.append("")
            lead = " " * max(0, min(self.indent, 2 * DEEP) - len(self.marker)) + self.marker
            self.lines.append((lead + line).rstrip())
            self.blank, self.marker = False, ""

    def block(self, spaced: bool):
        self.newline()
        self.blank = self.blank or spaced

    def result(self) -> str:
        self.newline()
        return "\n".join(self.lines).strip("\n")


def _columns(rows: list[list[tuple]]) -> list[list[tuple]] | None:
    """(column, columns spanned, lines) of every cell, beside the cells that reach down from rows above. None where
    that takes more steps than the table's size allows."""
    size = SPREAD * (16 + sum(map(len, rows)) + len(rows))
    busy: dict[int, int] = {}   # the row up to which a column is taken
    out, steps = [], 0
    for n, row in enumerate(rows):
        at, placed = 0, []
        for text, (wide, high) in row:
            while busy.get(at, 0) > n:
                at, steps = at + 1, steps + 1
            placed.append((at, wide, text.split("\n")))
            if high > 1:
                for k in range(at, at + wide):
                    busy[k] = n + high
            at, steps = at + wide, steps + wide
            if steps > size:
                return None
        out.append(placed)
    return out


def _table(rows: list[list[tuple]], page: Page):
    """Cells in columns: each as wide as its widest line, two spaces apart."""
    if not any(text for row in rows for text, _ in row):
        return
    page.block(True)
    placed = _columns(rows)
    if placed is not None:
        used = sorted({at for row in placed for at, _, _ in row})    # a column in which no cell starts has no width
        place = {at: k for k, at in enumerate(used)}
        wide = [0] * len(used)
        for row in placed:
            for at, span, lines in row:
                if span == 1:
                    wide[place[at]] = max(wide[place[at]], *map(len, lines))
        left = [0]
        for w in wide:
            left.append(left[-1] + w + 2)
        text = sum(len(line) + 2 for row in placed for _, _, lines in row for line in lines)
        drawn = sum(max((left[place[at]] + len(lines[0]) for at, _, lines in row), default=0)
                    * max((len(lines) for _, _, lines in row), default=0) for row in placed)
        if drawn > SPREAD * (text + 256):
            placed = None
    for k, row in enumerate(placed if placed is not None else rows):
        cells = ([(left[place[at]], lines) for at, _, lines in row] if placed is not None
                 else [(0, text.split("\n")) for text, _ in row])
        if not any(line for _, lines in cells for line in lines):
            continue
        depth = max(len(lines) for _, lines in cells)
        drawn = [[] for _ in range(depth)]
        ends = [0] * depth
        for at, lines in cells:
            for n, line in enumerate(lines):
                if line:
                    # a line of a cell over several columns may reach past where the next one starts
                    gap = max(at - ends[n], 2 if ends[n] else 0)
                    drawn[n].append(" " * gap + line)
                    ends[n] += gap + len(line)
        for parts in drawn:
            page.words = ["".join(parts)]
            page.newline(pre=True)
    page.blank = True


def render(root: Node) -> str:
    """Visible text of the tree. A work list stands for recursion: entries are nodes, or calls to make after them."""
    pages = [Page()]
    tables: list[list[list[tuple]]] = []
    lists: list[list] = []
    pre = deep = 0
    todo: list = [root]
    while todo:
        item = todo.pop()
        page = pages[-1]
        if isinstance(item, str):
            page.text(item, pre > 0)
            continue
        if isinstance(item, tuple):
            what, tag, span = item
            if what == "block":
                page.block(tag in SPACED)
            elif what == "pre":
                page.newline(pre=True)
                pre -= 1
            elif what == "list":
                lists.pop()
                page.newline()
                page.indent = max(0, page.indent - 2)
                page.blank = page.blank or not lists
            elif what == "cell":
                text = pages.pop().result()
                if tables:
                    if not tables[-1]:
                        tables[-1].append([])
                    tables[-1][-1].append((text, span))
            elif what == "table":
                _table(tables.pop(), page)
            elif what == "deep":
                deep -= 1
            continue
        if item.hidden:
            continue
        tag, after = item.tag, []
        rows = tables and not deep
        if tag == "br":
            page.newline(force=True)
        elif tag == "hr":
            page.block(True)
        elif tag == "table" and len(tables) < DEEP:
            page.newline()
            tables.append([])
            after.append(("table", tag, item.span))
        elif tag == "table":
            deep += 1
            page.block(True)
            after += [("deep", tag, item.span), ("block", tag, item.span)]
        elif tag == "tr" and rows:
            tables[-1].append([])
        elif tag in ("td", "th") and rows:
            pages.append(Page())
            after.append(("cell", tag, item.span))
        elif tag in ("ul", "ol", "menu"):
            page.block(not lists)
            page.indent += 2
            lists.append([tag, item.start])
            after.append(("list", tag, item.span))
        elif tag == "li":
            page.newline()
            if lists and lists[-1][0] == "ol":
                page.marker = f"{lists[-1][1]}. "
                lists[-1][1] += 1
            else:
                page.marker = "- "
            after.append(("block", tag, item.span))
        elif tag == "pre":
            page.block(True)
            pre += 1
            after += [("pre", tag, item.span), ("block", tag, item.span)]
        elif tag == "textarea":
            page.block(False)
            pre += 1
            after += [("pre", tag, item.span), ("block", tag, item.span)]
        elif tag in LINES and (item.svg or tag not in DRAWN) or tag in BLOCK and not (rows and tag in ("tbody", "thead", "tfoot")):
            page.block(tag in SPACED)
            after.append(("block", tag, item.span))
        todo += reversed(after)
        if tag == "details" and not item.start:
            todo += [c for c in item.children if isinstance(c, Node) and c.tag == "summary"][:1]
        else:
            todo += reversed(item.children)
    while len(pages) > 1:
        text = pages.pop().result()
        pages[-1].words.append(text)
    return pages[0].result()


def visible_text(html: str | None) -> str | None:
    return None if html is None else render(build(html))


def extract_text(pages: DataFrame, html_col: str = "html", out: str = "text") -> DataFrame:
    """``pages`` with the visible text of each page; every column is carried along."""
    @F.arrow_udf("string")
    def run(col: pa.Array) -> pa.Array:
        return pa.array([visible_text(x) for x in col.to_pylist()], pa.string())
    return pages.withColumn(out, run(F.col(html_col)))


def op7_html_text(spark, sf_dir: str) -> DataFrame:
    from spanweave.llm.common import table
    pages = table(spark, sf_dir, "pages").select("page_id", "html")
    return extract_text(pages).select("page_id", "text", F.length("text").cast("bigint").alias("n_chars"),
                                      F.size(F.split("text", "\n")).cast("bigint").alias("n_lines"))
