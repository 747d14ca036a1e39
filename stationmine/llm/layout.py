"""Visible text of HTML pages, laid out (operator 9).

A small tree builder follows the rules that shape text: implied end tags and table rows, raw text elements, void elements,
comments, end tags that match nothing, text and elements misplaced in tables, drawings and formulas. A renderer then walks the tree,
skips what is not visible and writes blocks, lists and tables as text.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stationmine.llm.tables import by_slice

# Sets of element names.
VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())
RAW = frozenset("script style title textarea xmp iframe noembed noframes noscript".split())
ESCAPABLE = frozenset("title textarea".split())
NEVER = frozenset(
    "head script style title template noscript noembed noframes iframe datalist area base link meta param rp "
    "source track audio video canvas object".split()
)
PARAGRAPHS = frozenset("p h1 h2 h3 h4 h5 h6 ul ol menu dl table pre blockquote figure hr listing xmp".split())
BLOCKS = PARAGRAPHS | frozenset(
    "html body address article aside center details dialog dd dir div dt fieldset figcaption footer form header hgroup "
    "legend li main nav optgroup option search section summary".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
INLINE_MARKS = frozenset("a b big code em font i nobr s small strike strong tt u span".split())
GROUPS = frozenset("thead tbody tfoot".split())
TABLE_PARTS = GROUPS | {"table", "tr"}
CELLS = frozenset(("td", "th", "caption"))
#: start tag → elements it stands in directly; others above them end.
CONTEXTS = {t: frozenset(("table",)) for t in GROUPS | {"caption", "colgroup"}}
CONTEXTS |= {"tr": GROUPS | {"table"}, "td": TABLE_PARTS, "th": TABLE_PARTS}
#: Drawings and formulas, what is not seen in them, start tags that end them and elements that may hold these.
FOREIGN = frozenset(("svg", "math"))
UNDRAWN = frozenset(
    "defs desc metadata symbol clippath mask marker pattern lineargradient radialgradient filter annotation annotation-xml".split()
)
BREAKOUTS = frozenset(
    "b big blockquote br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 hr i img li listing menu nobr ol p pre ruby s "
    "small span strong strike sub sup table tt u ul var".split()
)
HOLDERS = frozenset("foreignobject desc title mi mo mn ms mtext annotation-xml".split())
LISTS = frozenset("ul ol menu dir".split())

#: start tag → elements it ends, and elements it does not look beyond.
_WALL = CELLS | {"table", "template"}
ENDS: dict[str, tuple[frozenset, frozenset]] = {t: (frozenset(("p",)), _WALL | {"button"}) for t in BLOCKS - {"html", "body"}}
ENDS |= {
    "li": (frozenset(("li", "p")), _WALL | LISTS),
    "dt": (frozenset(("dt", "dd", "p")), _WALL | {"dl"}),
    "dd": (frozenset(("dt", "dd", "p")), _WALL | {"dl"}),
    "option": (frozenset(("option",)), _WALL | {"select", "optgroup"}),
    "optgroup": (frozenset(("option", "optgroup")), _WALL | {"select"}),
    "td": (CELLS, frozenset(("table", "tr"))),
    "th": (CELLS, frozenset(("table", "tr"))),
    "tr": (CELLS | {"tr"}, GROUPS | {"table"}),
    "caption": (CELLS | GROUPS | {"tr"}, frozenset(("table",))),
    "rt": (frozenset(("rt", "rp")), _WALL | {"ruby"}),
    "rp": (frozenset(("rt", "rp")), _WALL | {"ruby"}),
}
ENDS |= {t: (CELLS | GROUPS | {"tr", "colgroup"}, frozenset(("table",))) for t in GROUPS | {"colgroup"}}

_TABLE, _COLUMNS = frozenset(("table",)), frozenset(("colgroup",))

#: Elements nested deeper than this go beside each other.
DEEPEST = 200
#: Cells wider than this neither widen their column nor are padded.
WIDEST_CELL = 80
#: Cells that hold one of these are blocks, not columns.
LAID_OUT = frozenset(("table", "pre", "listing", "dl")) | LISTS
MOST_COLUMNS = 1000

_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
_ATTRIBUTE = re.compile(
    r"[\s/]*(?:(>)|([^\s/>][^\s/>=]*)(?:\s*=\s*(?:\"([^\"]*)(\"?)|'([^']*)('?)|([^\s>\"'][^\s>]*))?)?)"
)
_SPACE = re.compile(r"[ \t\n\f\r]+")
_RULE = re.compile(r"([^{}]+)\{([^{}]*)\}")
_HIDDEN = re.compile(r"(?:^|[;{\s])(?:display\s*:\s*none|visibility\s*:\s*(?:hidden|collapse))\b", re.I)
_SHOWN = re.compile(r"(?:^|[;{\s])visibility\s*:\s*visible\b", re.I)
_NO_DISPLAY = re.compile(r"(?:^|[;{\s])display\s*:\s*none\b", re.I)


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes = tag, attributes
        self.children: list[Node | str] = []


def _attributes(page: str, at: int) -> tuple[dict[str, str], int]:
    """Attributes from ``at`` on, and the place behind the tag; -1 if the page ends within the tag."""
    found: dict[str, str] = {}
    while m := _ATTRIBUTE.match(page, at):
        end, name, double, double_end, single, single_end, bare = m.groups()
        at = m.end()
        if end:
            return found, at
        if double_end == "" or single_end == "":
            return found, -1
        value = double if double is not None else single if single is not None else bare or ""
        found.setdefault(name.lower(), html.unescape(value) if "&" in value else value)
    return found, -1


def tokens(page: str) -> Iterator[tuple[str, str, dict[str, str] | None]]:
    """("text", text, None), ("start", name, attributes) and ("end", name, None). Every character is read a bounded number of times."""
    at, n, foreign = 0, len(page), 0
    while at < n:
        lt = page.find("<", at)
        if lt < 0:
            lt = n
        if lt > at:
            yield "text", page[at:lt], None
        if lt == n:
            return
        follows = page[lt + 1 : lt + 2]
        if follows == "!" or follows == "?" or follows == "/" and not _NAME.match(page, lt + 2):
            comment = page.startswith("<!--", lt) and not page.startswith(("<!-->", "<!--->"), lt)
            end = page.find("-->" if comment else ">", lt + 2)
            if end < 0:
                return
            at = end + (3 if comment else 1)
        elif follows == "/" or follows and _NAME.match(page, lt + 1):
            closing = follows == "/"
            m = _NAME.match(page, lt + 1 + closing)
            name = m[0].lower()
            attributes, at = _attributes(page, m.end())
            if at < 0:
                return
            if closing:
                foreign = max(0, foreign - (name in FOREIGN))
                yield "end", name, None
                continue
            alone = page[at - 2] == "/" and (foreign > 0 or name in FOREIGN)
            foreign += name in FOREIGN and not alone
            yield "start", name, attributes
            if alone:
                yield "end", name, None
            elif name in RAW:
                end = re.compile(rf"</{name}(?=[\s/>])", re.I).search(page, at)
                stop = end.start() if end else n
                if stop > at:
                    yield "raw", page[at:stop], None
                at = stop
        else:
            yield "text", "<", None
            at = lt + 1


def tree(page: str) -> tuple[Node, list[str]]:
    """The page's tree and the contents of its style elements."""
    root = Node("body", {})
    stack, styles = [root], []

    def pop_to(i: int) -> None:
        del stack[i:]

    def nearest(tags: frozenset[str]) -> int:
        return next((i for i in range(len(stack) - 1, 0, -1) if stack[i].tag in tags), 0)

    def put(child: Node | str) -> None:
        """Adds to the current element; what is misplaced in a table goes before the table, its parent's last child."""
        if stack[-1].tag in TABLE_PARTS and (table := nearest(_TABLE)):
            stack[table - 1].children.insert(-1, child)
        else:
            stack[-1].children.append(child)

    for kind, value, attributes in tokens(page):
        top = stack[-1]
        if kind == "text":
            text = html.unescape(value) if "&" in value else value
            if top.tag in _COLUMNS or top.tag in TABLE_PARTS:
                if not text.strip(" \t\n\f\r"):
                    continue
                if top.tag in _COLUMNS:
                    stack.pop()
            put(text)
        elif kind == "raw":
            if top.tag == "style":
                styles.append(value)
            else:
                top.children.append(html.unescape(value) if top.tag in ESCAPABLE else value)
        elif kind == "start":
            if value in ("html", "body"):
                root.attributes.update({k: v for k, v in attributes.items() if k not in root.attributes})
                continue
            if value == "head":
                continue
            if value in BREAKOUTS and (i := nearest(FOREIGN)) and nearest(HOLDERS) < i:
                pop_to(i)
            if stack[-1].tag in _COLUMNS and value != "col":
                stack.pop()
            in_table = any(x.tag == "table" for x in stack) if value in CELLS | GROUPS | {"tr", "col", "colgroup"} else True
            if not in_table:
                continue
            if value in ENDS:
                ends, walls = ENDS[value]
                first = None
                for i in range(len(stack) - 1, 0, -1):
                    if stack[i].tag in ends:
                        first = i
                    elif stack[i].tag in walls:
                        break
                if first is not None:
                    pop_to(first)
            if value in HEADINGS and stack[-1].tag in HEADINGS:
                stack.pop()
            if value in CONTEXTS:
                pop_to(nearest(CONTEXTS[value]) + 1)
            elif value in ("table", "form") and stack[nearest(TABLE_PARTS | CELLS)].tag in TABLE_PARTS:
                if value == "form":
                    stack[-1].children.append(Node(value, attributes))
                    continue
                pop_to(nearest(_TABLE))
            if value in ("td", "th") and stack[-1].tag in GROUPS | {"table"}:
                row = Node("tr", {})
                stack[-1].children.append(row)
                stack.append(row)
            node = Node(value, attributes)
            if value in CONTEXTS or value == "col":
                stack[-1].children.append(node)
            else:
                put(node)
            if value not in VOID and (len(stack) < DEEPEST or value in RAW):
                stack.append(node)
        else:
            if value == "br":
                put(Node("br", {}))
                continue
            same = HEADINGS if value in HEADINGS else (value,)
            walls = frozenset(("table",)) if value in CELLS | GROUPS | {"tr"} else CELLS | {"table"} if value != "table" else ()
            for i in range(len(stack) - 1, 0, -1):
                if stack[i].tag in same:
                    if value not in INLINE_MARKS or not any(x.tag in BLOCKS for x in stack[i + 1 :]):
                        pop_to(i)
                    break
                if stack[i].tag in walls:
                    break
    return root, styles


def hidden_names(styles: list[str]) -> frozenset[str]:
    """Selectors made of one name, class or id that style sheets do not display."""
    out = set()
    for sheet in styles:
        for m in _RULE.finditer(re.sub(r"/\*.*?(?:\*/|$)", "", sheet, flags=re.S)):
            if _NO_DISPLAY.search(m[2]):
                out.update(s for x in m[1].split(",") if re.fullmatch(r"[.#]?[\w-]+", s := x.strip()))
    return frozenset(out)


def _laid_out(cell: Node) -> bool:
    """Whether a list, an inner table or preformatted text stands in the cell, not counting what other cells hold."""
    left = [cell]
    while left:
        for child in left.pop().children:
            if isinstance(child, Node):
                if child.tag in LAID_OUT:
                    return True
                left.append(child)
    return False


class Page:
    """Writes visible nodes as lines. Pending spaces and line ends are written before the next text only."""

    def __init__(self, unseen: frozenset[str]):
        self.unseen = unseen
        self.out: list[str] = []
        self.gap, self.space, self.marker = 0, False, ""
        self.indent, self.drawn = 0, 0

    def _lead(self) -> str:
        if self.gap or not self.out:
            lead = "\n" * self.gap if self.out else ""
            lead += "  " * self.indent if not self.marker else self.marker
        else:
            lead = " " if self.space else ""
        self.gap, self.space, self.marker = 0, False, ""
        return lead

    def text(self, text: str) -> None:
        flat = _SPACE.sub(" ", text)
        body = flat.strip(" ")
        if body:
            self.space |= flat[0] == " "
            self.out.append(self._lead() + body)
        self.space |= flat[-1:] == " "

    def verbatim(self, text: str) -> None:
        for i, line in enumerate(text.split("\n")):
            if i:
                self.gap += 1
                self.space = False
            if line:
                self.out.append(self._lead() + line)

    def block(self, lines: int) -> None:
        self.gap, self.space = max(self.gap, lines), False

    def visible(self, node: Node, shown: bool) -> tuple[bool, bool]:
        """Whether the node is displayed, and whether text in it is visible."""
        a = node.attributes
        if node.tag in NEVER or "hidden" in a or node.tag == "dialog" and "open" not in a:
            return False, False
        if self.unseen and (
            node.tag in self.unseen
            or "#" + a.get("id", "") in self.unseen
            or any("." + c in self.unseen for c in a.get("class", "").split())
        ):
            return False, False
        style = a.get("style")
        if style:
            if _NO_DISPLAY.search(style):
                return False, False
            if _HIDDEN.search(style):
                shown = False
            elif _SHOWN.search(style):
                shown = True
        return True, shown

    def children(self, node: Node, shown: bool, pre: bool) -> None:
        closed = node.tag == "details" and "open" not in node.attributes
        number = 1
        if node.tag == "ol":
            start = node.attributes.get("start", "1").strip()
            number = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
        for child in node.children:
            if isinstance(child, str):
                if shown and not closed:
                    self.verbatim(child) if pre else self.text(child)
                continue
            if closed and child.tag != "summary":
                continue
            if child.tag == "li":
                displayed, seen = self.visible(child, shown)
                if displayed:
                    self.block(1)
                    deep = max(0, self.indent - 1)
                    self.marker = "  " * deep + (f"{number}. " if node.tag == "ol" else "- ") if seen else ""
                    number += 1
                    self.children(child, seen, pre)
                    self.marker = ""
                    self.block(1)
                continue
            self.node(child, shown, pre)

    def node(self, node: Node, shown: bool, pre: bool) -> None:
        displayed, shown = self.visible(node, shown)
        if not displayed:
            return
        tag = node.tag
        if self.drawn and tag in UNDRAWN:
            return
        self.drawn += tag in FOREIGN
        self.displayed(node, shown, pre)
        self.drawn -= tag in FOREIGN

    def displayed(self, node: Node, shown: bool, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            self.gap, self.space = self.gap + 1 if self.out else 0, False
        elif tag == "table":
            self.table(node, shown)
        else:
            lines = 2 if tag in PARAGRAPHS else 1 if tag in BLOCKS or self.drawn and tag in ("text", "mtr") else 0
            self.space |= self.drawn > 0 and tag == "mtd"
            nested = tag in LISTS and self.indent > 0
            if lines:
                self.block(1 if nested else lines)
            self.indent += tag in LISTS or tag == "dd"
            self.children(node, shown, pre or tag in ("pre", "listing", "xmp", "textarea"))
            self.indent -= tag in LISTS or tag == "dd"
            if lines:
                self.block(1 if nested else lines)

    def table(self, table: Node, shown: bool) -> None:
        self.block(2)
        rows: list[list[str]] = []
        whole: list[list[str]] = []  # cells of rows that are written as blocks, not as columns
        for part, seen in self._parts(table, shown):
            if part.tag == "caption":
                self.block(1)
                self.children(part, seen, False)
                self.block(1)
                continue
            row: list[str] = []
            texts: list[str] = []
            blocks = False
            for cell in part.children:
                if isinstance(cell, Node) and cell.tag in ("td", "th"):
                    displayed, inside = self.visible(cell, seen)
                    if not displayed:
                        continue
                    own = Page(self.unseen)
                    own.children(cell, inside, False)
                    span = cell.attributes.get("colspan", "1").strip()
                    texts.append(own.result())
                    row.append(_SPACE.sub(" ", texts[-1]).strip(" "))
                    blocks |= "\n" in texts[-1] and (len(texts[-1]) > WIDEST_CELL or _laid_out(cell))
                    if re.fullmatch(r"\d{1,4}", span):
                        row += [""] * (min(int(span), MOST_COLUMNS) - 1)
            texts = [t for t in texts if t]
            blocks |= len(texts) == 1 and "\n" in texts[0]
            rows.append([] if blocks else row)
            whole.append(texts if blocks else [])
        widths: list[int] = []
        for row in rows:
            widths += [0] * (len(row) - len(widths))
            for i, cell in enumerate(row):
                if len(cell) <= WIDEST_CELL:
                    widths[i] = max(widths[i], len(cell))
        for row, texts in zip(rows, whole):
            for text in texts:
                self.block(1)
                self.verbatim(text)
                self.block(1)
            while row and not row[-1]:
                row.pop()
            if row:
                self.block(1)
                line = "  ".join(c.ljust(w) for c, w in zip(row[:-1], widths))
                self.out.append(self._lead() + (line + "  " if len(row) > 1 else "") + row[-1])
        self.block(2)

    def _parts(self, table: Node, shown: bool) -> Iterator[tuple[Node, bool]]:
        for child in table.children:
            if isinstance(child, Node) and child.tag in GROUPS | {"tr", "caption"}:
                displayed, seen = self.visible(child, shown)
                if displayed and child.tag in GROUPS:
                    yield from self._parts(child, seen)
                elif displayed:
                    yield child, seen

    def result(self) -> str:
        return "".join(self.out)


def render(page: str | None) -> str:
    """All visible text of a page. Null: empty."""
    if not page:
        return ""
    root, styles = tree(page)
    out = Page(hidden_names(styles))
    out.node(root, True, False)
    return out.result()


def extract(pages: DataFrame) -> DataFrame:
    """page_id, text: one row per page, with its visible text.

    Blocks stand on lines of their own, paragraphs, headings, lists, tables and the like apart by an empty line; list items have
    a dash or their number; table cells are padded to columns. Null and empty html give an
    empty text, as do pages without visible text. Null or repeated page_ids are pages of their own. Only ``page_id``
    and ``html`` are read. No rows: no rows.
    """

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        texts = [render(x) for x in part.column("html").to_pylist()]
        return pa.RecordBatch.from_arrays([part.column("page_id"), pa.array(texts, pa.string())], ["page_id", "text"])

    rows = pages.select(F.col("page_id").cast("long"), F.col("html").cast("string"))
    return rows.mapInArrow(by_slice(work, "html"), "page_id long, text string")
