"""HTML extraction: a page's visible text as it is laid out.

A page goes through three small steps: tags and texts are told apart in one scan; a tree is
built, with the implied ends of `p`, `li`, table parts and the like; a renderer walks the tree and
writes what is visible. Blocks stand on lines of their own, paragraphs and headings are set off by
a blank line, list items have a marker and an indent by depth, `pre` keeps its white space, cells
of a table row stand in columns as wide as their widest cell, full-width characters counted as two.
A cell of several columns or rows leaves the others empty. Lines of more than `WIDEST_CELL` columns
overhang instead of widening their column, and indents end at `DEEPEST_INDENT` columns, so the size of
a text is in proportion to its page.

Formulas and the labels of drawings are text; of a `select`, the options marked `selected` are shown, or
all of a list box. Text that stands directly in a table or in its rows comes before the table.

Not visible: head, script, style, template, frames, media, what a drawing only defines, annotations of
formulas, a menu's first option where none is marked, comments, elements with `hidden`,
`aria-hidden="true"`, an inline style of `display:none`, or such a rule of the page's `style` elements
for a name, class or id alone (rules inside `@media` and the like are left out), closed `details` but
for their summary, closed dialogs, inputs of type hidden. `visibility:hidden` hides an element but
what in it is `visibility:visible` again. Buttons made by `input` show their value.

Null and empty pages have the empty text. Markup cut short or nested wrongly is read as far as it
goes: stray end tags are ignored, open elements end with the page, `<` before a blank is text, a quote
that no other follows ends with its tag, and a tag that the page's end cuts off is text. Both the scan and the tree
take time in proportion to the page. The walk keeps its own stack, so any depth of elements is read;
tables in more than 20 tables are laid out as blocks. Texts of any length are rendered whole. Repeated rows give equal texts, an empty table gives an empty result.
"""

import re
from bisect import bisect
from collections import defaultdict
from html import unescape
from unicodedata import east_asian_width

import pyarrow as pa
from pyspark.sql import DataFrame

from tallygrove.llm.common import extended, numbered

TAG_NAME = re.compile(r"[a-zA-Z][^\s/>]*")
BETWEEN = re.compile(r"[\s/]*")
ATTRIBUTE_NAME = re.compile(r"=?[^\s/>=]*")
EQUALS = re.compile(r"\s*=\s*")
BARE_VALUE = re.compile(r"[^\s>]*")
RAW_END = {}  # the pattern of each raw element's end tag
NOT_DISPLAYED = re.compile(r"(?:^|[;\s])display\s*:\s*none", re.IGNORECASE)
VISIBILITY = re.compile(r"(?:^|[;\s])visibility\s*:\s*(hidden|collapse|visible)", re.IGNORECASE)
PLAIN_SELECTOR = re.compile(r"[.#]?[a-zA-Z_][\w-]*")
BLANKS = re.compile(r"[ \t\n\r\f\x0b]+")

DEEPEST_TABLE = 20  # tables inside more tables than this are laid out as blocks
WIDEST_CELL = 160  # columns; longer lines overhang
DEEPEST_INDENT = 200  # columns

# Kinds of elements in HTML.
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
RAW = set("script style textarea title xmp iframe noembed noframes".split())
NEVER = set(
    "head script style template noscript title meta link iframe object embed canvas audio video"
    " datalist noembed noframes annotation annotation-xml".split()
)
DEFINED = set("defs desc metadata symbol clippath mask marker pattern".split())  # in svg only
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 blockquote pre ul ol dl table figure hr".split())
BLOCKS = PARAGRAPHS | set(
    "html body div section article aside header footer nav main address form fieldset legend li dt dd tr caption"
    " thead tbody tfoot details summary figcaption center dialog menu hgroup search option optgroup".split()
)
# An opening tag ends open elements of the first set, unless one of the second stands between.
CLOSES = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th"}, {"table", "tr"}),
    "th": ({"td", "th"}, {"table", "tr"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "option": ({"option"}, {"select", "datalist"}),
    "body": ({"head"}, set()),
}
CLOSES["tbody"] = CLOSES["tfoot"] = CLOSES["thead"]
CLOSES_P = BLOCKS - {"html", "body", "tr", "caption", "thead", "tbody", "tfoot", "option", "optgroup", "legend"}


class Element:
    __slots__ = ("name", "attributes", "children", "rules")

    def __init__(self, name, attributes):
        self.name, self.attributes, self.children = name, attributes, []


class Open:
    """The open elements. Where each name is open is kept, so no end tag needs a walk over the stack."""

    def __init__(self, top):
        self.stack, self.places, self.blocks = [top], defaultdict(list), []

    def push(self, element):
        self.places[element.name].append(len(self.stack))
        if element.name in BLOCKS:
            self.blocks.append(len(self.stack))
        self.stack.append(element)

    def cut(self, place):
        """End the element at a place, and all inside it."""
        for element in self.stack[place:]:
            self.places[element.name].pop()
            if element.name in BLOCKS:
                self.blocks.pop()
        del self.stack[place:]

    def last(self, name):
        return self.places[name][-1] if self.places.get(name) else 0

    def close(self, name):
        """End the nearest open element of that name; inside a table nothing ends what holds the table."""
        place = self.last(name)
        if place and (name in ("table", "body") or place > self.last("table")):
            self.cut(place)

    def imply_ends(self, name):
        if name in CLOSES_P and self.blocks and self.stack[self.blocks[-1]].name == "p":
            self.cut(self.blocks[-1])
        if self.stack[-1].name == "head" and name not in NEVER | {"base", "basefont", "bgsound"}:
            self.cut(len(self.stack) - 1)
        if name in CLOSES:
            ended, until = CLOSES[name]
            outer = max(map(self.last, until), default=0)
            inner = [
                places[at] for places in map(self.places.get, ended)
                if places and (at := bisect(places, outer)) < len(places)
            ]
            if inner:
                self.cut(min(inner))


def tree(html: str) -> Element:
    """The elements of a page; children are elements and texts."""
    top = Element("html", {})
    top.rules = set()
    opened = Open(top)
    last_end, last_section = html.rfind(">"), html.rfind("]]>")
    last_quote = {quote: html.rfind(quote) for quote in "\"'"}
    start = at = 0  # of the text under way, and of what is not read yet

    def text(stop):
        if start < stop:
            opened.stack[-1].children.append(unescape(html[start:stop]))

    while 0 <= (mark := html.find("<", at)) <= last_end or html.startswith("<!--", mark):
        if html.startswith("<!--", mark):
            text(mark)
            end = html.find("-->", mark + 4)
            start = at = end + 3 if end >= 0 else len(html)
            continue
        if html.startswith(("<!", "<?"), mark):
            text(mark)
            section = html.startswith("<![CDATA[", mark) and mark < last_section
            start = at = html.find("]]>", mark) + 3 if section else html.find(">", mark) + 1
            continue
        ending = html.startswith("/", mark + 1)
        found = TAG_NAME.match(html, mark + 1 + ending)
        if not found:
            at = mark + 1
            continue
        attributes, at = _attributes(html, found.end(), last_quote)
        if at < 0:
            break
        text(mark)
        start = at
        name = found[0].lower()
        if ending:
            opened.close(name)
            continue
        if name == "html":
            continue
        opened.imply_ends(name)
        element = Element(name, attributes)
        if name in DEFINED and opened.last("svg"):
            attributes["hidden"] = ""
        opened.stack[-1].children.append(element)
        if name in RAW:
            if name not in RAW_END:
                RAW_END[name] = re.compile(rf"</{name}[\s/>]", re.IGNORECASE)
            end = RAW_END[name].search(html, at)
            inside = html[at : end.start() if end else len(html)]
            element.children.append(unescape(inside) if name in ("textarea", "title") else inside)
            if name == "style":
                top.rules |= undisplayed(inside)
            at = html.find(">", end.start()) + 1 if end else len(html)
            start = at = at or len(html)
        elif name not in VOID:
            opened.push(element)
    text(len(html))
    return top


def _attributes(html, at, last_quote):
    """A tag's attributes, read from behind its name, and the place behind its `>`; -1 if the page ends first."""
    found = {}
    while True:
        at = BETWEEN.match(html, at).end()
        if at == len(html):
            return found, -1
        if html[at] == ">":
            return found, at + 1
        name = ATTRIBUTE_NAME.match(html, at)
        value, at = "", name.end()
        if equals := EQUALS.match(html, at):
            at = equals.end()
            quote = html[at : at + 1]
            if quote in last_quote and last_quote[quote] > at:
                end = html.find(quote, at + 1)
                value, at = html[at + 1 : end], end + 1
            else:
                bare = BARE_VALUE.match(html, at)
                value, at = bare[0], bare.end()
        found.setdefault(name[0].lower(), unescape(value))


def undisplayed(style: str) -> set:
    """The names, .classes and #ids that a style sheet's plain rules don't display."""
    found, depth = set(), 0
    for part in style.split("}"):
        if depth == 0 and part.count("{") == 1:
            selectors, _, rule = part.partition("{")
            if NOT_DISPLAYED.search(rule):
                selectors = map(str.strip, selectors.rpartition("*/")[2].split(","))
                found.update(x for x in selectors if PLAIN_SELECTOR.fullmatch(x))
        depth = max(0, depth + part.count("{") - 1)
    return found


def hidden(element: Element, rules=frozenset()) -> bool:
    if element.name in NEVER or element.name in rules:
        return True
    attributes = element.attributes
    if element.name == "dialog" and "open" not in attributes:
        return True
    return bool(attributes) and (
        "hidden" in attributes
        or attributes.get("aria-hidden", "").lower() == "true"
        or bool(NOT_DISPLAYED.search(attributes.get("style", "")))
        or element.name == "input"
        and attributes.get("type", "").lower() == "hidden"
        or bool(rules)
        and (
            "#" + attributes.get("id", "") in rules
            or any("." + x in rules for x in attributes.get("class", "").split())
        )
    )


def seen_in(element: Element, seen: bool) -> bool:
    """Whether what an element holds is seen, by its own visibility or else by that around it."""
    own = VISIBILITY.search(element.attributes.get("style", "")) if element.attributes else None
    return own[1].lower() == "visible" if own else seen


def width(text: str) -> int:
    """Columns of a text; full-width characters take two."""
    return len(text) if text.isascii() else sum(1 + (east_asian_width(x) in "WF") for x in text)


class Page:
    """Lines of text under way; breaks are kept back until text follows. `depth`: tables around it.

    `rules` are the page's names, classes and ids that are not displayed.
    """

    def __init__(self, depth, rules):
        self.depth, self.rules = depth, rules
        self.lines, self.words, self.gap, self.indent, self.marker = [], [], 0, "", ""
        self.blank = False

    def text(self, text, pre=False):
        if pre:
            first, *rest = text.split("\n")
            self._add(first)
            for line in rest:
                self.end_line(force=True)
                self._add(line)
            return
        if text[:1] in " \t\n\r\f\x0b" and text:
            self.blank = bool(self.words)
        parts = BLANKS.sub(" ", text).strip(" ")
        if parts:
            self._add((" " if self.blank and self.words else "") + parts)
            self.blank = False
        if parts and text[-1:] in " \t\n\r\f\x0b":
            self.blank = True

    def _add(self, text):
        if text:
            if not self.words and self.gap and self.lines:
                self.lines.extend([""] * (self.gap - 1))
            self.gap = 0
            self.words.append(text)

    def end_line(self, force=False):
        if self.words:
            self.lines.append(self.indent + self.marker + "".join(self.words))
            self.indent, self.marker = (self.indent + " " * len(self.marker))[:DEEPEST_INDENT], ""
        elif force:
            self.lines.append("")
        self.words, self.blank = [], False

    def set_off(self, gap):
        """End the line; `gap` - 1 blank lines before what follows."""
        self.end_line()
        self.gap = max(self.gap, gap)


def render(top: Element, depth: int = 0, rules=None, seen: bool = True) -> str:
    page = Page(depth, top.rules if rules is None else rules)
    _walk(page, top, seen)
    page.end_line()
    return "\n".join(line.rstrip() for line in page.lines).strip("\n")


def _walk(page, top, seen):
    """Write the visible text of an element; entries of the stack are steps still to do.

    An entry holds the item, whether white space is kept, the list around it and whether it is seen.
    """
    stack = [(top, False, None, seen)]
    while stack:
        item, pre, around, seen = stack.pop()
        if isinstance(item, str):
            if seen:
                page.text(item, pre)
            continue
        if not isinstance(item, Element):
            item()
            continue
        name = item.name
        if hidden(item, page.rules):
            continue
        seen = seen_in(item, seen)
        if name == "br":
            page.end_line(force=not page.words and bool(page.lines) and not page.gap)
            continue
        if name == "hr":
            page.set_off(2)
            continue
        if name in ("img", "input"):
            if seen:
                page.text(_label(item))
            continue
        if name == "table" and page.depth < DEEPEST_TABLE:
            page.set_off(2)
            _table(page, item, seen)
            page.set_off(2)
            continue
        inside, pre = around, pre or name == "pre"
        gap = int(name == "text") if name not in BLOCKS else 2 if name in PARAGRAPHS and not (around and name in ("ul", "ol", "p")) else 1
        if gap:
            page.set_off(gap)
        if name in ("ul", "ol", "menu"):
            inside = [name, _number(item.attributes.get("start"))]
        steps = [(child, pre, inside, seen) for child in _shown(item, page.rules)]
        if name == "pre" and steps and isinstance(item.children[0], str):
            steps[0] = (item.children[0].removeprefix("\n"), pre, inside, seen)
        if name in ("li", "dd"):
            before = page.indent
            bullet = "- " if not around or around[0] != "ol" else f"{around[1]}. "
            if name == "li" and around:
                around[1] += 1
            page.marker = bullet if name == "li" else "  "
            steps.append((lambda before=before: _unindent(page, before), pre, around, seen))
        if name == "blockquote":
            before, page.indent = page.indent, (page.indent + "  ")[:DEEPEST_INDENT]
            steps.append((lambda before=before: _unindent(page, before), pre, around, seen))
        if gap:
            steps.append((lambda gap=gap: page.set_off(gap), pre, around, seen))
        stack.extend(reversed(steps))


def _label(element):
    """A picture's alternative text, or what is written on a button."""
    kind = element.attributes.get("type", "").lower() if element.name == "input" else "image"
    if kind == "image":
        return element.attributes.get("alt", "")
    return element.attributes.get("value", "") if kind in ("submit", "reset", "button") else ""


def _unindent(page, indent):
    page.end_line()
    page.indent, page.marker = indent, ""


def _number(text):
    return int(text) if text and re.fullmatch(r"-?\d{1,9}", text) else 1


def _shown(element, rules):
    if element.name == "details" and "open" not in element.attributes:
        return [c for c in element.children if isinstance(c, Element) and c.name == "summary"]
    if element.name == "select" and "multiple" not in element.attributes and _number(element.attributes.get("size")) < 2:
        return _chosen(element, rules)
    return element.children


def _chosen(select, rules):
    """What a menu shows: the contents of its options marked as selected."""
    found, stack = [], list(reversed(select.children))
    while stack:
        child = stack.pop()
        if isinstance(child, str) or hidden(child, rules):
            continue
        if child.name == "option" and "selected" in child.attributes:
            found = child.children
        elif child.name != "option":
            stack.extend(reversed(child.children))
    return found


def _table(page, table, seen):
    """Rows of cells in columns; a cell of several lines keeps them, the columns and rows it spans are left empty."""
    rows, spanned = [], {}  # `spanned`: for how many more rows a column is taken
    stack = [(child, seen) for child in reversed(table.children)]
    while stack:
        child, seen = stack.pop()
        if isinstance(child, str):
            if seen and child.strip():
                page.text(child)
            continue
        if hidden(child, page.rules):
            continue
        seen = seen_in(child, seen)
        if child.name in ("thead", "tbody", "tfoot"):
            spanned = {}
            stack.extend((x, seen) for x in reversed(child.children))
        elif child.name == "tr":
            for loose in child.children:
                if isinstance(loose, str) and seen and loose.strip():
                    page.end_line()
                    page.text(loose)
                    page.end_line()
            cells = [c for c in child.children if isinstance(c, Element) and not hidden(c, page.rules)]
            row, spanned = _row(page, cells, spanned, seen)
            rows.append(row)
        elif child.name not in ("col", "colgroup"):
            page.text(_part(page, [child], seen), pre=True)
            page.end_line()
    page.end_line()
    widths = {}
    for row in rows:
        for column, lines in row:
            wide = (w for w in map(width, lines) if w <= WIDEST_CELL)
            widths[column] = max(widths.get(column, 0), max(wide, default=0))
    starts, at = {}, 0
    for column in sorted(widths):
        starts[column] = at
        at += widths[column] + 2
    for row in rows:
        for line in range(max((len(lines) for _, lines in row), default=0)):
            parts, at = [], 0
            for column, lines in row:
                if line < len(lines) and lines[line]:
                    parts.append(" " * max(starts[column] - at, 2 if parts else 0) + lines[line])
                    at += width(parts[-1])
            page.text("".join(parts), pre=True)
            page.end_line(force=True)


def _row(page, cells, spanned, seen):
    """The (column, lines) of a row's cells, and the columns that cells take in the rows below."""
    row, below, column = [], {c: n - 1 for c, n in spanned.items() if n > 1}, 0
    for cell in cells:
        while column in spanned:
            column += 1
        row.append((column, _part(page, cell.children, seen_in(cell, seen)).split("\n")))
        wide = max(1, min(_number(cell.attributes.get("colspan")), 1000))
        high = _number(cell.attributes.get("rowspan"))
        if high != 1:
            below.update(dict.fromkeys(range(column, column + wide), high - 1 if high > 0 else 1 << 30))
        column += wide
    return row, below


def _part(page, children, seen):
    """The text of a part of a table, laid out by itself."""
    inner = Element("div", {})
    inner.children = children
    return render(inner, page.depth + 1, page.rules, seen)


def visible_text(html) -> str:
    return render(tree(html)) if html else ""


def extract(pages: DataFrame, html: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` but the markup, and the visible text in `out`. No shuffle.

    A column named like `out` is replaced.
    """
    names = pages.drop(html, out).columns
    rows = numbered(pages.select(f"`{html}`", *[f"`{name}`" for name in names]))

    def extracted(batches):
        for batch in batches:
            texts = pa.array([visible_text(x) for x in batch.column(0).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], texts], [*batch.schema.names[1:], "text"])

    return rows.mapInArrow(extracted, extended(rows.drop("c0"), text="string")).toDF(*names, out)
