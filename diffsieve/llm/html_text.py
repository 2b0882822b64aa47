"""Visible text of HTML pages.

A page is cut into tags, comments and text; a stack of open elements closes what HTML closes by implication; the
resulting tree is rendered as a reader sees it: hidden parts are left out, blocks get their own lines, paragraphs a
blank line, list items a mark or number, table cells are padded to aligned columns.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable
from itertools import zip_longest

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from diffsieve.llm.common import add_columns, with_text

# Classes of elements as the HTML standard has them.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes plaintext".split())
HIDDEN = set(
    "head script style template noscript title iframe noembed noframes datalist object audio video canvas svg math".split()
)
BLOCKS = set(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form "
    "h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol option optgroup p pre search section summary table tbody "
    "td tfoot th thead tr ul caption".split()
)
SPACED = set("p h1 h2 h3 h4 h5 h6 ul ol dl menu dir pre blockquote table figure hr".split())
CLOSES_P = BLOCKS - set("body html tbody td tfoot th thead tr caption option optgroup legend".split())
#: An element on the left ends open elements on the right, up to one of SCOPE.
IMPLIED = {
    "li": {"li"}, "dt": {"dt", "dd"}, "dd": {"dt", "dd"}, "option": {"option"}, "optgroup": {"option", "optgroup"},
    "tr": {"tr", "td", "th", "caption"}, "td": {"td", "th"}, "th": {"td", "th"},
    "tbody": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, "thead": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"},
    "tfoot": {"tr", "td", "th", "tbody", "thead", "tfoot", "caption"}, "body": {"head"},
}
SCOPE = {
    "li": {"ul", "ol", "menu", "dir"}, "dt": {"dl"}, "dd": {"dl"}, "option": {"select"}, "optgroup": {"select"},
    "tr": {"table"}, "td": {"tr", "table"}, "th": {"tr", "table"}, "tbody": {"table"}, "thead": {"table"}, "tfoot": {"table"},
}
#: Elements that an end tag of another element does not close past.
WALLS = {"table", "td", "th", "caption", "body", "html"}

TOKEN = re.compile(
    r"<!--(?:.*?--!?>|.*\Z)|<!\[CDATA\[(?P<data>.*?)\]\]>|<[!?][^>]*>?"
    r"|<(?P<end>/?)(?P<name>[A-Za-z][^\s/>]*+)(?P<rest>(?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+)>",
    re.S,
)
#: A tag is sought by pattern within so many characters; ends of longer tags come from LongTags.
TAG_CHARS = 8_192
NAME_END, MARK = re.compile(r"[\s/>]"), re.compile(r"[>\"']")
#: Elements nested deeper than this become siblings, as in browsers.
DEEPEST = 500

ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+)))?")
OFF_STYLE = re.compile(r"display\s*:\s*none", re.I)
#: Whether a style says that the element's own content is seen; the last such declaration counts.
SIGHT = re.compile(r"visibility\s*:\s*(visible|hidden|collapse)", re.I)
SPACES = re.compile(r"[ \t\n\r\f]+")


class Element:
    __slots__ = ("attributes", "children", "name")

    def __init__(self, name: str, attributes: dict[str, str]) -> None:
        self.name, self.attributes, self.children = name, attributes, []


def attributes_of(rest: str) -> dict[str, str]:
    found: dict[str, str] = {}
    for name, double, single, plain in ATTRIBUTE.findall(rest):
        found.setdefault(name.lower(), html.unescape(double or single or plain))
    return found


class LongTags:
    """Finds ends of tags of any length in time linear in the page, however many searches fail.

    Outside quotes only the next mark (``>`` or a quote) decides how a search goes on, so the outcome at every mark is
    remembered and no stretch is walked twice. Tags are asked for in the order of the page.
    """

    def __init__(self, page: str) -> None:
        self.page = page
        self.outcome: dict[int, int] = {}
        self.ahead: dict[re.Pattern, int] = {}

    def next(self, pattern: re.Pattern, at: int) -> int:
        """The first match at or behind ``at``, the page's size if there is none; ``at`` never falls by pattern."""
        if self.ahead.get(pattern, -1) < at:
            m = pattern.search(self.page, at)
            self.ahead[pattern] = m.start() if m else len(self.page)
        return self.ahead[pattern]

    def end(self, at: int) -> int:
        """The place of the ``>`` that ends the tag whose attributes begin at ``at``; -1 if none does."""
        mark, path = self.next(MARK, at), []
        while mark not in self.outcome:
            path.append(mark)
            if mark >= len(self.page):
                self.outcome[mark] = -1
            elif self.page[mark] == ">":
                self.outcome[mark] = mark
            elif (closing := self.page.find(self.page[mark], mark + 1)) < 0:
                self.outcome[mark] = -1
            else:
                m = MARK.search(self.page, closing + 1)
                mark = m.start() if m else len(self.page)
        for passed in path:
            self.outcome[passed] = self.outcome[mark]
        return self.outcome[mark]

    def tag(self, at: int) -> tuple[str, str, str, int] | None:
        """``/`` or nothing, name, attributes and end of the tag at ``at``."""
        slash = self.page[at + 1 : at + 2] == "/"
        first = at + 1 + slash
        letter = self.page[first : first + 1]
        if not (letter.isascii() and letter.isalpha()):
            return None
        name_end = self.next(NAME_END, first + 1)
        end = self.end(name_end)
        return None if end < 0 else ("/" * slash, self.page[first:name_end], self.page[name_end:end], end + 1)


def parse(page: str) -> Element:
    """The tree of a page. Never fails: what is no tag is text, open elements end with the page."""
    root = Element("#root", {})
    stack = [root]
    at = 0
    size = len(page)
    long_tags, by_marks = LongTags(page), False
    while at < size:
        tag = page.find("<", at)
        if tag < 0:
            stack[-1].children.append(html.unescape(page[at:]))
            break
        if tag > at:
            stack[-1].children.append(html.unescape(page[at:tag]))
        special = page[tag + 1 : tag + 2] in ("!", "?")
        if special:
            m = TOKEN.match(page, tag)
        else:
            m = None if by_marks else TOKEN.match(page, tag, tag + TAG_CHARS)
        if m is None:
            by_marks = True  # the page has long or open tags: the pattern would walk TAG_CHARS for each
            found = None if special else long_tags.tag(tag)
            if found is None:
                stack[-1].children.append("<")
                at = tag + 1
                continue
            ends, name, rest, at = found
        else:
            at = m.end()
            if m["data"] is not None:
                stack[-1].children.append(m["data"])
            if m["name"] is None:
                continue
            ends, name, rest = m["end"], m["name"], m["rest"]
        name = name.lower()
        if ends:
            close(stack, name)
            continue
        open_element(stack, name, attributes_of(rest) if rest else {})
        if name in RAW:
            done = re.compile(rf"</{name}(?=[\s/>]|\Z)[^>]*>?", re.I).search(page, at)
            text = page[at : done.start()] if done else page[at:]
            stack[-1].children.append(html.unescape(text) if name in ("textarea", "title") else text)
            stack.pop()
            at = done.end() if done else size
    return root


def open_element(stack: list[Element], name: str, attributes: dict[str, str]) -> None:
    if name in CLOSES_P:
        close_implied(stack, {"p"}, {"button", "td", "th", "table", "caption", "object"})
    if name in IMPLIED:
        close_implied(stack, IMPLIED[name], SCOPE.get(name, set()))
    if name in ("html", "body") and any(e.name == name for e in stack):
        return
    if name in ("td", "th") and stack[-1].name in ("table", "tbody", "thead", "tfoot"):
        open_element(stack, "tr", {})
    element = Element(name, attributes)
    stack[-1].children.append(element)
    if name not in VOID:
        if len(stack) > DEEPEST:
            stack.pop()
        stack.append(element)


def close_implied(stack: list[Element], ends: set[str], walls: set[str]) -> None:
    """Ends the outermost open element of ``ends`` that stands inside the nearest wall."""
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name in walls:
            walled = i
            break
    else:
        walled = 0
    for i in range(walled + 1, len(stack)):
        if stack[i].name in ends:
            del stack[i:]
            return


def close(stack: list[Element], name: str) -> None:
    """An end tag. One without an open element is ignored, but ``</br>`` and ``</p>`` stand for themselves."""
    if name == "br":
        stack[-1].children.append(Element("br", {}))
        return
    for i in range(len(stack) - 1, 0, -1):
        if stack[i].name == name:
            del stack[i:]
            return
        if stack[i].name in WALLS and name not in BLOCKS:
            return
    if name == "p":
        stack[-1].children.append(Element("p", {}))


def hidden(element: Element) -> bool:
    if element.name in HIDDEN:
        return True
    a = element.attributes
    if not a:
        return False
    if "hidden" in a or OFF_STYLE.search(a.get("style", "")):
        return True
    return element.name == "input" or (element.name == "dialog" and "open" not in a)


def sight(element: Element) -> bool | None:
    """What the element's style says of its visibility; None if nothing."""
    said = SIGHT.findall(element.attributes.get("style", "")) if element.attributes else []
    return said[-1].lower() == "visible" if said else None


def drop_unseen(root: Element) -> None:
    """Takes texts and images out of elements whose visibility is hidden. Visibility is inherited, but an element inside may be
    visible again; elements in which nothing is seen go wholly."""
    todo: list[tuple[Element, bool]] = [(root, True)]
    unseen: list[Element] = []
    while todo:
        node, seen = todo.pop()
        if not seen:
            unseen.append(node)
            node.children = [x for x in node.children if isinstance(x, Element) and (x.name not in VOID or sight(x))]
        for x in node.children:
            if isinstance(x, Element):
                own = sight(x)
                todo.append((x, seen if own is None else own))
    # parents come before their children, so going backwards an emptied child is gone before its parent is looked at
    empty = set()
    for node in reversed(unseen):
        node.children = [x for x in node.children if id(x) not in empty]
        if not node.children:
            empty.add(id(node))
    if empty:
        todo2 = [root]
        while todo2:
            node = todo2.pop()
            node.children = [x for x in node.children if isinstance(x, str) or id(x) not in empty]
            todo2 += [x for x in node.children if isinstance(x, Element)]


class Lines:
    """Lines under construction: white space collapses, blocks begin lines, gaps become one blank line."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.parts: list[str] = []
        self.space = False
        self.gap = False
        self.mark = ""

    def words(self, text: str, kept: bool) -> None:
        if kept:
            first, *others = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
            self.put(first)
            for line in others:
                self.end(always=True)
                self.put(line)
            return
        text = SPACES.sub(" ", text)
        if text[:1] == " ":
            self.space, text = True, text[1:]
        if not text:
            return
        if self.space and self.parts:
            self.parts.append(" ")
        self.space = text[-1] == " "
        self.put(text[:-1] if self.space else text)

    def put(self, text: str) -> None:
        if text:
            self.parts.append(text)

    def end(self, always: bool = False) -> None:
        """Ends the line if it has text."""
        line = "".join(self.parts).rstrip(" ")
        self.parts, self.space = [], False
        if line or always:
            if self.gap and self.lines and self.lines[-1]:
                self.lines.append("")
            self.gap = False
            self.lines.append(self.mark + line)
            self.mark = " " * len(self.mark)

    def block(self, spaced: bool) -> None:
        self.end()
        self.gap = self.gap or (spaced and bool(self.lines))


def render(root: Element) -> list[str]:
    """The lines of all visible text, without recursion, so that deep pages are no trouble."""
    out = Lines()
    # entries: an element or text to render, or a function to call
    todo: list = [(root, False, 0)]
    while todo:
        entry = todo.pop()
        if callable(entry):
            entry()
            continue
        node, kept, depth = entry
        if isinstance(node, str):
            out.words(node, kept)
            continue
        name = node.name
        if name == "br":
            out.end(always=True)
        elif hidden(node):
            pass
        elif name == "img":
            if alt := node.attributes.get("alt", ""):
                out.words(alt, False)
        elif name == "table":
            out.block(True)
            for line in table_lines(node):
                out.put(line)
                out.end(always=True)
            out.block(True)
        elif name == "details" and "open" not in node.attributes:
            out.block(False)
            todo.append(lambda out=out: out.block(False))
            todo += [(x, kept, depth) for x in node.children if isinstance(x, Element) and x.name == "summary"][:1]
        else:
            is_block = name in BLOCKS
            spaced = name in SPACED and not (depth and name in ("ul", "ol", "menu", "dir"))
            if is_block:
                out.block(spaced)
                todo.append(lambda out=out, spaced=spaced: out.block(spaced))
            inside = depth + (name in ("ul", "ol", "menu", "dir"))
            keeps = kept or name in ("pre", "textarea", "xmp")
            if name == "li":
                todo += item(node, out, keeps, inside)
            else:
                if name in ("ol", "ul", "menu", "dir"):
                    number(node)
                todo += [(x, keeps, inside) for x in reversed(node.children)]
    out.end()
    while out.lines and not out.lines[-1]:
        out.lines.pop()
    return out.lines


def number(node: Element) -> None:
    """Gives each item of a list its mark."""
    start = node.attributes.get("start", "1")
    n = int(start) if re.fullmatch(r"-?\d{1,9}", start) else 1
    for x in node.children:
        if isinstance(x, Element) and x.name == "li":
            own = x.attributes.get("value", "") if x.attributes else ""
            n = int(own) if re.fullmatch(r"-?\d{1,9}", own) else n
            x.attributes = {**x.attributes, "#mark": f"{n}. " if node.name == "ol" else "- "}
            n += 1


def item(node: Element, out: Lines, kept: bool, depth: int) -> list:
    """What renders a list item: its first line carries the mark, further lines are indented as far."""
    before = out.mark
    indent = " " * len(before)
    mark = node.attributes.get("#mark", "- ")

    def enter() -> None:
        out.mark = indent + mark

    def leave() -> None:
        out.end()
        out.mark = indent

    return [leave, *((x, kept, depth) for x in reversed(node.children)), enter]


def table_lines(table: Element) -> list[str]:
    """Rows as lines with aligned columns. A cell of several lines takes several lines; a table with nested tables or
    without rows falls back to its blocks."""
    rows, captions, todo = [], [], list(reversed(table.children))
    loose: list = []
    while todo:
        x = todo.pop()
        if isinstance(x, str):
            if x.strip():
                loose.append(x)
        elif hidden(x):
            continue
        elif x.name in ("tbody", "thead", "tfoot"):
            todo += reversed(x.children)
        elif x.name == "tr":
            rows.append([c for c in x.children if isinstance(c, Element) and c.name in ("td", "th") and not hidden(c)])
        elif x.name == "caption":
            captions.append(x)
        elif x.name not in ("col", "colgroup"):
            loose.append(x)
    lines = [line for x in [*loose, *captions] for line in rendered(x)]
    cells = placed_cells(rows)
    columns: list[int] = []
    for row in cells:
        for at, wide, text in row:
            columns += [0] * (at + wide - len(columns))
            if wide == 1:
                columns[at] = max([columns[at], *map(len, text)])
    for row in cells:
        parts, widths, at = [], [], 0
        for start, wide, text in row:
            for free in range(at, start):
                parts.append([])
                widths.append(columns[free])
            parts.append(text)
            at = start + wide
            widths.append(sum(columns[start:at]) + 3 * (wide - 1))
        for line in zip_longest(*parts, fillvalue=""):
            lines.append(" | ".join(x.ljust(w) for x, w in zip(line, widths, strict=True)).rstrip())
    return lines


def placed_cells(rows: list[list[Element]]) -> list[list[tuple[int, int, list[str]]]]:
    """Of every row the cells as (first column, columns, lines). A cell that spans rows keeps its columns in the rows below,
    where it has no text."""
    out: list[list[tuple[int, int, list[str]]]] = []
    # by first column: columns, and rows that are still spanned
    held: dict[int, tuple[int, int]] = {}
    for row in rows:
        placed, at, above = [], 0, sorted(held.items())
        held = {start: (wide, n - 1) for start, (wide, n) in above if n > 1}
        spans = iter(above)
        block = next(spans, None)
        for cell in row:
            wide = span(cell, "colspan", 1000)
            while block is not None and block[0] < at + wide:
                placed.append((block[0], block[1][0], []))
                at = max(at, block[0] + block[1][0])
                block = next(spans, None)
            placed.append((at, wide, rendered(cell)))
            if (deep := span(cell, "rowspan", 65534)) > 1:
                held[at] = (wide, deep - 1)
            at += wide
        while block is not None and row:
            placed.append((block[0], block[1][0], []))
            block = next(spans, None)
        out.append(placed)
    return out


def rendered(node: Element | str) -> list[str]:
    root = Element("#root", {})
    root.children = node.children if isinstance(node, Element) and node.name in ("td", "th") else [node]
    return render(root)


def span(cell: Element, attribute: str, most: int) -> int:
    """The columns or rows that a cell spans, at most as many as browsers take."""
    wide = cell.attributes.get(attribute, "1")
    return min(max(int(wide), 1), most) if re.fullmatch(r"\d{1,9}", wide) else 1


#: Deeper tables are rendered as blocks, so that no page can exhaust the stack.
DEEPEST_TABLE = 20


def flatten_deep_tables(root: Element) -> None:
    todo = [(root, 0)]
    while todo:
        node, depth = todo.pop()
        if node.name == "table":
            depth += 1
        if depth > DEEPEST_TABLE and node.name in ("table", "tbody", "thead", "tfoot", "tr", "td", "th", "caption"):
            node.name = "div"
        todo += [(x, depth) for x in node.children if isinstance(x, Element)]


def visible_text(page: str) -> str:
    root = parse(page)
    drop_unseen(root)
    flatten_deep_tables(root)
    return "\n".join(render(root))


def extract_text(pages: DataFrame, page_id: str = "page_id", page: str = "html") -> DataFrame:
    """``page_id, text, n_lines`` for every row of ``pages``: the visible text of the whole page.

    A null or empty page, and one without visible text, has an empty text and 0 lines. Text that is no HTML comes out
    as it is, with white space collapsed. Repeated rows repeat their result, a null id stays null, other columns are
    not read. No page fails: wrong nesting is mended as described above. Elements deeper than DEEPEST are put beside each
    other, tables deeper than DEEPEST_TABLE are rendered as blocks; no text is lost by either.
    """

    def begin() -> Callable:
        return lambda texts: [[visible_text(x) for x in texts]]

    made = add_columns(with_text(pages, page_id, page), "__text", [("text", T.StringType())], begin)
    return made.select(
        F.col("__id").alias("page_id"), "text",
        F.when(F.col("text") == "", 0).otherwise(F.size(F.split("text", "\n"))).cast("long").alias("n_lines"),
    )
