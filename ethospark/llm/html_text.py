"""HTML extraction: the visible text of a page with its layout.

A page is read once, tag by tag. Open elements are a stack; implied ends close what a new tag cannot
be inside of (a paragraph by a block, an item by an item, a cell by a cell, …), an end tag closes up
to its element, one without an element is ignored. What is not rendered gives no text: scripts,
styles, the head, templates, comments, fallbacks of media, dialogs that aren't open, elements with
the attribute ``hidden`` or whose own style hides them. Blocks begin on a new line, some with an
empty line around; list items have a bullet or number (``start``, ``value``, ``reversed``) and are indented
by depth; cells of a table are padded to their column's width, with ``colspan`` (at most 1,000), ``rowspan``
(up to the end of the row group) and all lines they hold; every option of a select and every text of a
drawing has a line; preformatted text and text areas keep their white space, other white space
collapses.

Scale: pages are independent, one pass without a shuffle; the stack is explicit and knows where each
tag is open, so depth costs nothing. Column widths follow lines of at most ``WIDE`` characters, longer ones
stick out; a table whose padding would exceed ``PADDING`` times its text has none, each row is one line
then. Row spans are followed in the first ``SPANNED`` columns.

Defined cases: a null page gives null text; an empty page, or one without visible text, empty text;
unclosed tags and comments end with the page; repeated rows are extracted each; null ids pass
through. An empty table gives an empty table. Other columns pass through but for ``text``, which
is replaced.
"""

from __future__ import annotations

import html
import re
from bisect import bisect_right
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame

from ethospark.llm.text import pieces

VOID = set("area base br col embed hr img input link meta param source track wbr".split())
UNSEEN = set("head script style template noscript iframe object datalist audio video canvas title".split())
RAW = {"script", "style", "textarea", "title", "iframe", "noscript"}  # no tags inside
PARAGRAPHS = set("p h1 h2 h3 h4 h5 h6 ul ol dl table blockquote pre figure hr menu".split())  # an empty line around
BLOCKS = PARAGRAPHS | set(
    "address article aside body caption center dd details dialog div dt fieldset figcaption footer form header html legend li main nav section summary tr".split()
)
#: a tag ends these open elements, up to the nearest of the bounds
IMPLIED = {
    **{t: ({"p"}, {"table", "td", "th", "caption", "li", "button"}) for t in BLOCKS - {"html", "body", "tr", "caption"}},
    "li": ({"li", "p"}, {"ul", "ol", "menu", "table"}),
    "dt": ({"dt", "dd", "p"}, {"dl", "table"}),
    "dd": ({"dt", "dd", "p"}, {"dl", "table"}),
    "tr": ({"tr", "td", "th", "p", "caption", "colgroup"}, {"table"}),
    "td": ({"td", "th", "p"}, {"tr", "table"}),
    "th": ({"td", "th", "p"}, {"tr", "table"}),
    **{t: ({"tr", "td", "th", "thead", "tbody", "tfoot", "caption", "colgroup", "p"}, {"table"}) for t in ("thead", "tbody", "tfoot")},
    "body": ({"head"}, {"html"}),
    "option": ({"option"}, {"select"}),
    "optgroup": ({"option", "optgroup"}, {"select"}),
}
#: elements of drawings and formulas that show none of their text, those that hold HTML, and HTML that ends both
FOREIGN_UNSEEN = set("defs desc metadata symbol clippath mask pattern marker annotation annotation-xml".split())
FOREIGN_HTML = set("foreignobject mi mo mn ms mtext".split())
BREAKS_OUT = set(
    "b big blockquote body br center code dd div dl dt em embed h1 h2 h3 h4 h5 h6 head hr i img li listing menu meta nobr ol p pre ruby s small"
    " span strong strike sub sup table tt u ul var".split()
)
_TOKEN = re.compile(
    r"<!--(?P<comment>.*?)(?:-->|\Z)|<[!?][^>]*(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<rest>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)(?:>|\Z)", re.S
)
_ATTRIBUTE = re.compile(r"""([^\s/>=]+)(?:\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"'][^\s>]*))?)?""")
_NEEDED = re.compile("hidden|style|colspan|rowspan|start|value|reversed|open|label", re.I)  # attributes that are read
_COMMENT = re.compile(r"/\*.*?(?:\*/|\Z)", re.S)
_NUMBER = re.compile(r"\s*([-+]?\d{1,9})(?!\d)")  # longer ones are no number
WIDE, PADDING, SPANNED = 120, 16, 256
_WHITE = re.compile(r"[ \t\n\r\f]+")


def _attributes(rest: str) -> dict[str, str]:
    """Name and value of a tag's attributes; the first of a name counts."""
    found = {}
    if _NEEDED.search(rest):
        for name, *values in _ATTRIBUTE.findall(rest):
            found.setdefault(name.lower(), html.unescape("".join(values)))
    return found


def _style(value: str) -> dict[str, str]:
    """Property and value of declarations; the last counts, but for important ones."""
    plain, important = {}, {}
    for declaration in _COMMENT.sub("", value).lower().split(";"):
        name, _, what = declaration.partition(":")
        what, mark, _ = what.partition("!")
        (important if mark else plain)[name.strip()] = what.strip()
    return plain | important


class Lines:
    """Text as lines; the one being written collapses white space."""

    def __init__(self):
        self.done, self.now, self.gap, self.space = [], [], 0, False

    def write(self, text: str, keep: bool = False) -> None:
        if keep:
            if self.now and self.space:
                self.now.append(" ")
            self.space = False
            first, *more = text.replace("\r\n", "\n").split("\n")
            self.now.append(first)
            for line in more:
                self.end(True)
                self.now.append(line)
            return
        parts = _WHITE.split(text)
        if parts[0] == "" and len(parts) > 1:
            self.space = True
        words = [x for x in parts if x]
        if words:
            if self.now and self.space:
                self.now.append(" ")
            self.now.append(" ".join(words))
            self.space = parts[-1] == "" and len(parts) > 1

    def end(self, empty: bool = False) -> None:
        """Ends the line; an empty one counts only where it was asked for."""
        if self.now or empty:
            if self.done:
                self.done += [""] * self.gap
            self.done.append("".join(self.now).rstrip())
            self.gap = 0
        self.now, self.space = [], False

    def block(self, gap: int) -> None:
        self.end()
        self.gap = max(self.gap, gap)

    def add(self, lines: list[str]) -> None:
        for line in lines:
            self.now = [line]
            self.end(True)

    def close(self) -> list[str]:
        self.end()
        return self.done


class Page:
    """One page: a stack of (tag, hidden, lines that the element collects or None, state, mode around it)."""

    def __init__(self):
        self.stack = []
        self.at = defaultdict(list)  # places of the open elements of each tag
        self.tables, self.rows, self.lists = [], [], []  # states of those that are shown
        self.out = [Lines()]  # of the elements that collect: cells, items, quotes
        self.unseen, self.kept = 0, 0
        self.mode = (False, "", False)  # invisible by style, in svg or math, in a drawing outside its texts

    def _shown(self) -> bool:
        return not (self.unseen or self.mode[0] or self.mode[2])

    def text(self, text: str) -> None:
        if text and self._shown():
            state = self.stack[-1][3] if self.stack else None
            if state is not None and "rows" in state and not text.strip():
                return
            self.out[-1].write(html.unescape(text), self.kept > 0)

    def open(self, tag: str, rest: str) -> None:
        if self.mode[1] and tag in BREAKS_OUT:
            while self.mode[1]:
                self._pop()
        if (self.mode[1] or tag in ("svg", "math")) and rest.endswith("/"):
            return
        if tag in IMPLIED:
            ends, bounds = IMPLIED[tag]
            self._imply(ends, bounds)
        if tag == "br":
            if self._shown():
                self.out[-1].end(not self.out[-1].now)
            return
        if not self.unseen and tag in BLOCKS:
            self.out[-1].block(1 if tag in PARAGRAPHS and not self._inside_list(tag) else 0)
        if tag in VOID:
            if tag == "hr" and self._shown():
                self.out[-1].add(["---"])
                self.out[-1].block(1)
            return
        attributes = _attributes(rest)
        style = _style(attributes.get("style", ""))
        invisible, foreign, muted = mode = self.mode
        hidden = tag in UNSEEN or "hidden" in attributes or style.get("display") == "none"
        hidden = hidden or tag == "dialog" and "open" not in attributes or bool(foreign) and tag in FOREIGN_UNSEEN
        if style.get("visibility") in ("hidden", "collapse", "visible"):
            invisible = style["visibility"] != "visible"
        if tag in ("svg", "math"):
            foreign, muted = tag, tag == "svg"
        elif foreign and tag in FOREIGN_HTML:
            foreign, muted = "", False
        elif foreign == "svg" and tag == "text":
            muted = False
        self.mode = (invisible, foreign, muted)
        numbers = {k: int(v[1]) for k in ("colspan", "rowspan", "start", "value") if (v := _NUMBER.match(attributes.get(k, "")))}
        state, lines = None, None
        if not (self.unseen or hidden):
            if tag in ("option", "optgroup") or tag == "text" and foreign == "svg":
                state = {"line": True}
                self.out[-1].block(0)
                if tag != "text" and attributes.get("label"):  # is shown in place of the option's text
                    self.text(html.escape(attributes["label"]))
                    hidden = tag == "option"
                    self.out[-1].block(0)
            elif tag in ("ul", "ol", "menu"):
                state = {"list": tag, "next": numbers.get("start"), "items": []}
                state["back"] = tag == "ol" and "reversed" in attributes
                self.lists.append(state)
            elif tag == "table":
                state = {"rows": [], "caption": []}
                self.tables.append(state)
            elif tag in ("thead", "tbody", "tfoot") and self.tables:
                self.tables[-1]["rows"].append(None)  # row spans end here
            elif tag == "tr" and self.tables:
                state = {"cells": []}
                self.rows.append(state)
                self.tables[-1]["rows"].append(state["cells"])
            elif tag in ("td", "th", "li", "blockquote", "caption"):
                lines = Lines()
                state = {"span": min(max(1, numbers.get("colspan", 1)), 1000), "value": numbers.get("value")}
                state["down"] = numbers["rowspan"] or 65534 if numbers.get("rowspan", -1) >= 0 else 1
                self.out.append(lines)
            elif tag in ("pre", "textarea"):
                state = {"pre": True}
                self.kept += 1
        self.unseen += hidden
        self.at[tag].append(len(self.stack))
        self.stack.append((tag, hidden, lines, state, mode))

    def _inside_list(self, tag: str) -> bool:
        return tag in ("ul", "ol", "menu") and any(x[0] == "li" for x in self.stack[-3:])

    def _last(self, tags) -> int:
        """Place of the innermost open element of these tags."""
        return max((self.at[t][-1] for t in tags if self.at[t]), default=-1)

    def _imply(self, ends: set, bounds: set) -> None:
        within = self._last(bounds)
        inside = [self.at[t][k] for t in ends if (k := bisect_right(self.at[t], within)) < len(self.at[t])]
        while inside and len(self.stack) > min(inside):
            self._pop()

    def close(self, tag: str) -> None:
        bounds = () if tag in ("tr", "table", "tbody", "thead", "tfoot", "html", "body") else ("td", "th", "table")
        place = self._last([tag])
        if place >= 0 and place >= self._last(bounds):
            while len(self.stack) > place:
                self._pop()

    def _pop(self) -> None:
        tag, hidden, lines, state, self.mode = self.stack.pop()
        self.at[tag].pop()
        for kind, states in (("rows", self.tables), ("cells", self.rows), ("list", self.lists)):
            if state and kind in state:
                states.pop()
        self.unseen -= hidden
        if self.unseen or hidden:
            return
        if state and state.get("pre"):
            self.kept -= 1
        if lines is not None:
            self.out.pop()
            self._collected(tag, lines.close(), state)
        elif state and "rows" in state:
            self.out[-1].block(1)
            self.out[-1].add(state["caption"] + _table_lines(state["rows"]))
        elif state and state.get("items"):  # a list that counts down knows its numbers at its end
            number = len(state["items"]) if state["next"] is None else state["next"]
            for value, item in state["items"]:
                number = number if value is None else value
                self._item(f"{number}. ", item)
                number -= 1
        if tag in BLOCKS or state and "line" in state:
            self.out[-1].block(1 if tag in PARAGRAPHS and not self._inside_list(tag) else 0)

    def _collected(self, tag: str, lines: list[str], state: dict) -> None:
        if tag in ("td", "th") and self.rows:
            self.rows[-1]["cells"].append(([x for x in lines if x.strip()], state["span"], state["down"]))
            return
        if tag == "caption" and self.tables:
            self.tables[-1]["caption"] += lines
            return
        if tag == "blockquote":
            self.out[-1].add(["> " + x if x else ">" for x in lines])
        elif tag == "li" and lines:
            owner = self.lists[-1] if self.lists else None
            if not owner or owner["list"] != "ol":
                self._item("- ", lines)
            elif owner["back"]:
                owner["items"].append((state["value"], lines))
            else:
                following = 1 if owner["next"] is None else owner["next"]
                number = following if state["value"] is None else state["value"]
                owner["next"] = number + 1
                self._item(f"{number}. ", lines)
        else:
            self.out[-1].add(lines)

    def _item(self, mark: str, lines: list[str]) -> None:
        self.out[-1].add([mark + lines[0], *[" " * len(mark) + x if x else "" for x in lines[1:]]])

    def finish(self) -> str:
        while self.stack:
            self._pop()
        lines = self.out[0].close()
        return "\n".join(lines).strip("\n")


def _table_lines(rows: list) -> list[str]:
    """Rows of (lines, columns, rows spanned) cells as text; None ends a group of rows."""
    width, until, placed = defaultdict(int), {}, []  # until: the row that a column is free again in
    for r, row in enumerate(rows):
        if row is None:
            until = {}
            continue
        at, cells = 0, []
        for lines, span, down in row:
            while until.get(at, 0) > r:
                at += 1
            cells.append((at, span, lines))
            if down > 1:
                until |= dict.fromkeys(range(at, min(at + span, SPANNED)), r + down)
            if span == 1:
                width[at] = max([width[at], *[len(x) for x in lines if len(x) <= WIDE]])
            at += span
        if cells:
            placed.append(cells)
    edge = [0]  # sums of the widths
    for c in range(max(width, default=-1) + 1):
        edge.append(edge[-1] + width.get(c, 0))
    wide = lambda a, b: edge[min(b, len(edge) - 1)] - edge[min(a, len(edge) - 1)] + 3 * max(b - a - 1, 0)
    height = [max([1, *[len(lines) for _, _, lines in cells]]) for cells in placed]
    text = sum(3 + sum(map(len, lines)) for cells in placed for _, _, lines in cells)
    out = []
    if sum(n * wide(0, cells[-1][0]) for n, cells in zip(height, placed)) > PADDING * text + 1000:
        out = [" | ".join(" ".join(x.strip() for x in lines) for _, _, lines in cells) for cells in placed]
        height, placed = [], []
    for n, cells in zip(height, placed):
        for k in range(n):
            parts, at = [], 0
            for begin, span, lines in cells:
                if begin > at:  # columns that cells of earlier rows span
                    parts += [" " * wide(c, c + 1) for c in range(at, begin)]
                parts.append((lines[k] if k < len(lines) else "").ljust(wide(begin, begin + span)))
                at = begin + span
            out.append(" | ".join(parts))
    return [x.rstrip() for x in out if x.strip(" |")]


def extract(page: str) -> str:
    """The visible text of one page."""
    found, at, size = Page(), 0, len(page)
    while at < size:
        token = _TOKEN.search(page, at)
        if token is None:
            found.text(page[at:])
            break
        found.text(page[at : token.start()])
        at = token.end()
        if not token["name"]:
            continue
        tag = token["name"].lower()
        if token["end"]:
            found.close(tag)
            continue
        found.open(tag, token["rest"])
        if tag in RAW:
            end = re.compile(f"</{re.escape(tag)}(?=[\\s/>])", re.I).search(page, at)
            begin, at = at, end.start() if end else size
            if tag == "textarea":  # a line break at its beginning is not shown
                found.text(re.sub(r"\A\r?\n", "", page[begin:at]))
    return found.finish()


def extract_text(pages_: DataFrame, html_column: str = "html", text_column: str = "text") -> DataFrame:
    """``pages_`` with the visible text in place of the markup."""
    kept = [f for f in pages_.schema.fields if f.name not in (html_column, text_column)]
    schema = ", ".join([*[f"`{f.name}` {f.dataType.simpleString()}" for f in kept], f"`{text_column}` string"])

    def task(batches):
        for piece in pieces(batches, html_column):
            texts = [None if x is None else extract(x) for x in piece.column(html_column).to_pylist()]
            yield pa.record_batch([*[piece.column(f.name) for f in kept], pa.array(texts, pa.string())], [*[f.name for f in kept], text_column])

    return pages_.select(*[f.name for f in kept], html_column).mapInArrow(task, schema)
