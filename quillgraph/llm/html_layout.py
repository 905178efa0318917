"""HTML to text by layout-aware rendering.

A tokenizer that accepts any input feeds a tree builder with implied tags (html, head and body need not be there; p, li, dt, dd, tr,
td, th, option and the like close where their successors open; stray end tags are ignored; what is open at the end closes).
The tree is rendered with visibility rules (script, style, head, template and other elements that show nothing; `hidden`,
display:none, visibility:hidden, closed details and dialogs) into all visible text: blocks on their own lines with blank lines around
paragraphs and headings, list items with bullets or numbers and indents, table cells in aligned columns, preformatted
text as it stands, other white space collapsed. Formulas give their signs in order, drawings their text labels, a closed select the option it
shows, buttons and text fields their values.

Null html gives null, empty html the empty text. Broken or cut-off markup never fails; nesting of any depth is rendered without recursion, and work
grows with the page's length: elements that may not be open are not looked for, and a block within more than `DEEPEST` other blocks (inline elements don't
count) is laid out in the block at that depth, its text whole. Row and column spans reach as far as the table's other cells. Repeated rows are rendered each,
very long pages whole, an empty table gives an empty result; of the other columns none is read, whatever their names.
"""

from __future__ import annotations

import re
from bisect import bisect
from collections.abc import Iterator
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEEPEST = 200

# Element sets of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
RAW_TEXT = frozenset("textarea title".split())
UNSEEN = frozenset("head title script style template noscript noembed noframes iframe object audio video canvas datalist param source track area base link meta rp".split())
#: Shown nowhere inside svg or math.
UNDRAWN = frozenset("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
#: Parts of a formula that stand apart from what is before them: cells, and what these hold (numerators, exponents, limits).
APART = frozenset("mtr mtd".split())
HOLDS_APART = frozenset("mfrac msub msup msubsup munder mover munderover mmultiscripts mroot".split())
#: Input types whose value is no text on the page.
WORDLESS = frozenset("hidden password checkbox radio file color range image".split())
HEAD_ONLY = frozenset("base link meta title style script template noscript".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul caption tbody thead tfoot tr td th listing xmp".split()
)
SPACED = frozenset("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir blockquote pre table figure hr listing xmp".split())
CLOSES_P = BLOCK - frozenset("option optgroup td th tr tbody thead tfoot caption body html legend".split())
#: Opening tag -> what it closes, and what such an open element is not looked for beyond.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table", "td", "th"}),
    "dt": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "dd": ({"dt", "dd"}, {"dl", "table", "td", "th"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "th": ({"td", "th", "caption", "colgroup"}, {"table", "tr"}),
    "tbody": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "thead": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"tbody", "thead", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_BARRIER = frozenset("table td th caption button object template body html".split())
_BOUNDED = {"li": frozenset("ul ol menu dir table".split()), "td": frozenset({"table"}), "th": frozenset({"table"}), "tr": frozenset({"table"}), "p": _BARRIER}

_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:--!?>|\Z))|<[!?][^>]*(?:>|\Z)|</([a-zA-Z][^\s/>]*)[^>]*(?:>|\Z)|</[^>]*(?:>|\Z)|<([a-zA-Z][^\s/>]*)((?:[^>\"'=]|=\s*(?:\"[^\"]*\"|'[^']*')?|[\"'])*)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s\"'>/=]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'=<>`]+)))?")
_SPACE = re.compile(r"[ \t\n\r\f]+")
_HIDING = re.compile(r"(?<![\w-])(?:display\s*:\s*none|content-visibility\s*:\s*hidden)", re.I)
_VISIBILITY = re.compile(r"(?<![\w-])visibility\s*:\s*(visible|hidden|collapse)", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: str = ""):
        self.tag, self.attributes, self.children = tag, attributes, []

    def get(self, name: str) -> str | None:
        for m in _ATTRIBUTE.finditer(self.attributes):
            if m[1].lower() == name:
                return unescape(next((x for x in m.groups()[1:] if x is not None), ""))
        return None


def build(html: str) -> Node:
    """The tree under one root."""
    root = Node("html")
    stack = [root]
    places: dict[str, list[int]] = {}  # of each tag, where it is open

    def push(node: Node) -> None:
        places.setdefault(node.tag, []).append(len(stack))
        stack.append(node)

    def cut(i: int) -> None:
        """Close what is open from place i on."""
        while len(stack) > i:
            places[stack.pop().tag].pop()

    def last(tags) -> int:
        """The place of the innermost open element of `tags`; 0 if there is none."""
        return max((places[t][-1] for t in tags if places.get(t)), default=0)

    def close(tags, within) -> None:
        """Close the innermost open element of `tags`, unless one of `within` is open inside it."""
        i = last(tags)
        if i and i >= last(within):
            cut(i)

    def text(raw: str, entities: bool = True) -> None:
        if raw:
            if stack[-1].tag == "head" and raw.strip():
                cut(len(stack) - 1)  # text is no part of a head: a body is implied
            if stack[-1].tag in ("table", "tr", "tbody", "thead", "tfoot") and not raw.strip():
                return
            stack[-1].children.append(unescape(raw) if entities and "&" in raw else raw)

    at, size, lower = 0, len(html), None
    while at < size:
        m = _TOKEN.search(html, at)
        if m is None:
            text(html[at:])
            break
        text(html[at : m.start()])
        at = m.end()
        if m[1]:
            tag = m[1].lower()
            if tag == "br":
                stack[-1].children.append(Node("br"))
            elif tag == "p" and not places.get("p"):
                stack[-1].children.append(Node("p"))
            elif tag not in ("html", "body"):
                close((tag,) if tag[:1] != "h" or tag[1:] not in "123456" else ("h1", "h2", "h3", "h4", "h5", "h6"), _BOUNDED.get(tag, _BARRIER - {tag} if tag not in BLOCK else ()))
            continue
        if not m[2]:
            continue
        tag, attributes = m[2].lower(), m[3] or ""
        if tag in ("html", "body"):
            if tag == "body" and stack[-1].tag == "head":
                cut(len(stack) - 1)
            root.attributes += " " + attributes if tag == "body" else ""
            continue
        if stack[-1].tag == "head" and tag not in HEAD_ONLY:
            cut(len(stack) - 1)
        if tag in IMPLIED:
            close_tags, within = IMPLIED[tag]
            if tag in ("tr", "tbody", "thead", "tfoot", "td", "th"):
                bound = last(within)  # all of them up to the table or row
                first = min((next(x for x in places[t][bisect(places[t], bound) :]) for t in close_tags if places.get(t) and places[t][-1] > bound), default=0)
                if first:
                    cut(first)
            else:
                close(close_tags, within)
        if tag in CLOSES_P:
            close(("p",), _BARRIER)
        if tag in ("td", "th") and stack[-1].tag in ("table", "tbody", "thead", "tfoot"):
            row = Node("tr")
            stack[-1].children.append(row)
            push(row)
        node = Node(tag, attributes)
        stack[-1].children.append(node)
        if (tag in UNDRAWN or tag not in BLOCK and attributes.rstrip().endswith("/")) and last(("svg", "math")):
            if attributes.rstrip().endswith("/"):
                continue
            node.attributes += " hidden"
        if tag in RAW or tag in RAW_TEXT:
            if lower is None:
                lower = html.lower() if len(html.lower()) == size else re.sub("[A-Z]", lambda x: x[0].lower(), html)
            end = lower.find("</" + tag, at)
            body = html[at : end if end >= 0 else size]
            node.children.append(unescape(body) if tag in RAW_TEXT else body)
            stop = html.find(">", end) if end >= 0 else -1
            at = stop + 1 if stop >= 0 else size
        elif tag not in VOID and not (attributes.rstrip().endswith("/") and tag not in BLOCK and tag in ("path", "g", "use")):
            push(node)
    return root


def visible(node: Node, parent: Node | None) -> bool:
    tag, attributes = node.tag, node.attributes
    if tag in UNSEEN:
        return False
    if parent is not None and parent.tag == "details" and tag != "summary" and parent.get("open") is None:
        return False
    if tag == "dialog" and node.get("open") is None:
        return False
    if attributes:
        low = attributes.lower()
        if "hidden" in low and node.get("hidden") is not None:
            return False
        if "style" in low and _HIDING.search(node.get("style") or ""):
            return False
    return True


def concealed(node: Node, inherited: bool) -> bool:
    """Whether text directly in the element is invisible by `visibility`, which children inherit and may take back."""
    if "visib" in node.attributes.lower():
        found = _VISIBILITY.findall(node.get("style") or "")
        if found:
            return found[-1].lower() != "visible"
    return inherited


def shown_option(select: Node) -> Node | None:
    """The option that a closed select shows: the last selected one, else the first that is not disabled."""
    first = chosen = None
    rest = [(x, False) for x in reversed(select.children)]
    while rest:
        x, off = rest.pop()
        if isinstance(x, str):
            continue
        off = off or x.get("disabled") is not None
        if x.tag != "option":
            rest.extend((y, off) for y in reversed(x.children))
        elif x.get("selected") is not None:
            chosen = x
        elif first is None and not off:
            first = x
    return first if chosen is None else chosen


class Layout:
    """Lines of one block context. Inline text gathers in `line`; blocks end lines and ask for blank lines around them."""

    def __init__(self, pre: bool = False):
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = False  # white space is due before the next inline text
        self.blank = False  # a blank line is due before the next line
        self.pre = pre

    def inline(self, text: str, pre: bool) -> None:
        if pre:
            parts = text.replace("\r\n", "\n").split("\n")
            for i, part in enumerate(parts):
                if i:
                    self.end(True)
                if part:
                    self.line.append(part)
            return
        text = _SPACE.sub(" ", text)
        if text == " ":
            self.space = self.space or bool(self.line)
            return
        if (self.space or text[0] == " ") and self.line:
            self.line.append(" ")
        self.line.append(text.strip(" "))
        self.space = text[-1] == " "

    def end(self, force: bool = False) -> None:
        line = "".join(self.line).rstrip(" ")
        if line or force:
            self.add([line])
        self.line, self.space = [], False

    def add(self, lines: list[str]) -> None:
        if self.blank and self.lines:
            self.lines.append("")
        self.blank = False
        self.lines.extend(lines)

    def block(self, lines: list[str], spaced: bool) -> None:
        self.end()
        while lines and not lines[0]:
            lines = lines[1:]
        while lines and not lines[-1]:
            lines = lines[:-1]
        if lines:
            self.blank = self.blank or spaced
            self.add(lines)
            self.blank = spaced

    def done(self) -> list[str]:
        self.end()
        return self.lines


class _Table:
    """Rows of cells; rendered with columns as wide as their widest single line. A cell that spans rows is shown in its first; the columns it covers below stay
    empty. A column span ends at the last column that the table's cells begin in."""

    def __init__(self):
        self.rows: list[list[tuple[list[str], int, int]]] = []
        self.captions: list[str] = []

    def _placed(self) -> list[list[tuple[int, int, list[str]]]]:
        """For each row its cells as (first column, columns, lines)."""
        taken: dict[int, int] = {}  # column -> rows below for which a cell above covers it
        placed, columns = [], 0
        for row in self.rows:
            at, cells, below = 0, [], dict(taken)
            for lines, span, down in row:
                while taken.get(at, 0) > 0:
                    at += 1
                cells.append((at, span, lines))
                columns = max(columns, at + 1)
                if down > 1:
                    for j in range(at, at + min(span, 1000)):
                        below[j] = down
                at += span
            taken = {j: n - 1 for j, n in below.items() if n > 1}
            placed.append(cells)
        return [[(at, max(1, min(span, columns - at)), lines) for at, span, lines in cells] for cells in placed]

    def done(self) -> list[str]:
        width: dict[int, int] = {}
        placed = self._placed()
        for cells in placed:
            for at, span, lines in cells:
                if span == 1:
                    width[at] = max(width.get(at, 0), *(len(x) for x in lines or [""]))
        out = list(self.captions)
        for cells in placed:
            for k in range(max((len(lines) for *_, lines in cells), default=0)):
                column, line = 0, []
                for at, span, lines in cells:
                    line += [" " * width.get(j, 0) for j in range(column, at)]
                    room = sum(width.get(at + j, 0) for j in range(span)) + 2 * (span - 1)
                    line.append((lines[k] if k < len(lines) else "").ljust(room))
                    column = at + span
                out.append("  ".join(line).rstrip())
        return out


def _int(text: str | None, default: int) -> int:
    """The whole number that a text begins with, as attributes are read."""
    m = re.match(r"\s*([+-]?\d{1,15})", text or "")
    return int(m[1]) if m else default


def _span(text: str | None) -> int:
    return max(_int(text, 1), 1)


def render(html: str) -> str:
    """All visible text of a page."""
    top = Layout()
    # each frame: node, children seen, layout, pre, how it ends
    frames: list[list] = [[build(html), 0, top, False, None]]
    # beside each frame: whether its text is concealed, how many blocks it is in, whether a list item is around it
    around: list[tuple[bool, int, bool]] = [(concealed(frames[0][0], False), 0, False)]
    tables: list[_Table] = []
    numbers: list[int | None] = []
    drawings: list[Node] = []
    while frames:
        node, i, layout, pre, ending = frames[-1]
        if len(around) < len(frames):  # the frame was opened by the last child
            hide, depth, item = around[-1]
            around.append((concealed(node, hide), depth + (node.tag in BLOCK), item or node.tag == "li"))
        hide, depth, _ = around[-1]
        if i >= len(node.children):
            frames.pop()
            around.pop()
            if ending:
                ending()
            continue
        frames[-1][1] += 1
        child = node.children[i]
        if isinstance(child, str):
            if drawings and next(f[0].tag for f in reversed(frames) if f[0].tag in ("svg", "text", "foreignobject")) == "svg":
                continue  # only labels are drawn
            if not hide and (node.tag != "details" or node.get("open") is not None):
                layout.inline(child, pre)
            continue
        tag = child.tag
        if tag == "br":
            layout.end(True)
        elif tag == "wbr" or not visible(child, node):
            if tag == "hr":
                layout.block([], True)
        elif tag == "svg":
            drawings.append(child)
            frames.append([child, 0, layout, pre, drawings.pop])
        elif tag == "text" and drawings or tag in APART or node.tag in HOLDS_APART:
            layout.inline(" ", False)
            frames.append([child, 0, layout, pre, lambda x=layout: x.inline(" ", False)])
        elif tag == "input":
            if (child.get("type") or "").strip().lower() not in WORDLESS and not concealed(child, hide):
                layout.inline(f" {child.get('value') or ''} ", False)
        elif tag == "select" and child.get("multiple") is None and _int(child.get("size"), 1) <= 1:
            option = shown_option(child)
            if option is not None:
                layout.inline(" ", False)
                if option.get("label") and not concealed(child, hide):
                    layout.inline(f" {option.get('label')} ", False)
                else:
                    frames.append([option, 0, layout, pre, lambda x=layout: x.inline(" ", False)])
        elif tag not in BLOCK or depth > DEEPEST:
            if tag in BLOCK:
                layout.end()
                frames.append([child, 0, layout, pre or tag == "pre", layout.end])
            elif tag == "q":
                layout.inline('"', True)
                frames.append([child, 0, layout, pre, lambda x=layout: x.line.append('"')])
            else:
                frames.append([child, 0, layout, pre or tag == "textarea", None])
        elif tag == "table":
            table = _Table()
            tables.append(table)

            def ending(layout=layout, table=table) -> None:
                tables.pop()
                layout.block(table.done(), True)

            frames.append([child, 0, Layout(), pre, ending])
            frames[-1][4] = lambda own=frames[-1][2], layout=layout, table=table, end=ending: (table.captions.extend(own.done()), end())
        elif tag == "tr" and tables:
            tables[-1].rows.append([])
            frames.append([child, 0, layout, pre, None])
        elif tag in ("tbody", "thead", "tfoot") and tables:
            frames.append([child, 0, layout, pre, None])
        elif tag in ("td", "th") and tables and tables[-1].rows:
            own = Layout()
            spans = _span(child.get("colspan")), _span(child.get("rowspan"))
            frames.append([child, 0, own, pre, lambda own=own, spans=spans, row=tables[-1].rows[-1]: row.append((own.done(), *spans))])
        elif tag in ("ul", "ol", "menu", "dir"):
            nested = around[-1][2]
            own = Layout()
            numbers.append(_int(child.get("start"), 1) if tag == "ol" else None)

            def ending(layout=layout, own=own, nested=nested) -> None:
                numbers.pop()
                layout.block(own.done(), not nested)

            frames.append([child, 0, own, pre, ending])
        elif tag == "li":
            own, mark = Layout(), "- "
            if numbers and numbers[-1] is not None:
                numbers[-1] = _int(child.get("value"), numbers[-1])
                mark = f"{numbers[-1]}. "
                numbers[-1] += 1

            def ending(layout=layout, own=own, mark=mark) -> None:
                lines = own.done()
                pad = " " * len(mark)
                layout.block([(mark if k == 0 else pad) + x if x or k == 0 else "" for k, x in enumerate(lines)] if lines else [], False)

            frames.append([child, 0, own, pre, ending])
        else:
            own = Layout()
            indent = {"blockquote": "> ", "dd": "  "}.get(tag, "")
            frames.append([child, 0, own, pre or tag in ("pre", "listing", "xmp"), lambda own=own, layout=layout, tag=tag, indent=indent: layout.block([(indent + x).rstrip() if indent else x for x in own.done()], tag in SPACED)])
    return "\n".join(top.done())


def _render(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = [None if x is None else render(x) for x in batch.column("html").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("url"), pa.array(texts, pa.string())], ["id", "url", "text"])


def extract(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(id, url, text) of every page: one narrow pass, no shuffle."""
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return rows.mapInArrow(_render, f"id {rows.schema['id'].dataType.simpleString()}, url string, text string").withColumnsRenamed({"id": id_col, "url": url_col})
