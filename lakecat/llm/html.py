"""HTML extraction by layout: all visible text of a page, set out as a reader sees it.

A tree builder reads tags with the implied ones of HTML (a paragraph ends where a block starts, a list item where the next one
starts, table parts nest by rank, void elements have no end, an end tag closes what is open inside it; what stands in a table outside of its
cells goes before it, cells in elements between row and cell count as the row's), then a renderer writes
the visible text: runs of white space are one space outside <pre>, blocks stand on lines of their own, paragraphs, headings,
lists and tables are set off by a blank line, list items have marks and indent, table cells are aligned in columns.

Invisible are: what browsers never show (scripts, styles, head, templates, fallback content, comments), hidden inputs, closed <details> but
for the summary, and what the cascade of style sheets and style attributes gives display:none, visibility:hidden or collapse (a
descendant may be visible again) or content-visibility:hidden; `hidden` and closed dialogs are display:none unless a declaration shows them.
Rules count for screens. Rules that cannot be decided here (combinators, attributes, window sizes) may show an element, never hide it.

Defined results: null and empty pages give an empty text; malformed markup never fails: what is no tag is text, a tag whose quote is
closed nowhere ends at its next `>`; a page of any length is read whole, in time that grows with its length, and is a task's unit of
work; elements deeper than DEPTH count as children of the one at that depth, as in browsers; a cell is padded to at most PAD columns; repeated rows
render alike; null ids pass through; an empty table gives an empty result; extra columns pass through `extracted`.
"""

from __future__ import annotations

import html as entities
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

DEPTH, PAD, SPAN = 256, 60, 1000
_BLOCK_BYTES = 4 << 20

#: Fixed values of the HTML standard: elements by what they do.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style xmp iframe noembed noframes noscript plaintext".split())
ESCAPABLE = frozenset("textarea title".split())
NEVER = frozenset("head title script style template noscript noframes noembed iframe object video audio canvas map datalist meta link base param source track area rp".split())
BLOCK = frozenset(
    "address article aside blockquote body center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html legend li main menu nav ol optgroup option p pre search section summary table ul".split()
)
SPACED = frozenset("blockquote dl figure h1 h2 h3 h4 h5 h6 hr ol p pre table ul menu dir".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl dd dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr li main menu nav ol p pre search section summary table ul".split()
)
HEADINGS = frozenset("h1 h2 h3 h4 h5 h6".split())
#: An element of the first kind closes open ones of the second, up to one of the third.
IMPLIED = {
    "li": ({"li"}, {"ul", "ol", "menu", "dir", "table"}),
    "dt": ({"dt", "dd"}, {"dl", "table"}),
    "dd": ({"dt", "dd"}, {"dl", "table"}),
    "option": ({"option"}, {"select", "datalist", "optgroup"}),
    "optgroup": ({"option", "optgroup"}, {"select", "datalist"}),
    "tr": ({"tr", "td", "th", "caption", "colgroup"}, {"table", "thead", "tbody", "tfoot"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
    "thead": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tbody": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "tfoot": ({"thead", "tbody", "tfoot", "tr", "td", "th", "caption", "colgroup"}, {"table"}),
    "rt": ({"rt", "rp"}, {"ruby"}),
    "rp": ({"rt", "rp"}, {"ruby"}),
}
_SCOPE = frozenset("table td th caption button object template html".split())

#: A quote that is closed nowhere is a character like others: there is one of each kind at most, so the scan stays linear.
_TOKEN = re.compile(r"<!--(?:>|->|.*?(?:-->|--!>|\Z))|<[!?][^>]*(?:>|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>\"']++|\"[^\"]*\"|'[^']*'|[\"'])*+)(?:>|\Z)", re.S)
_ATTRIBUTE = re.compile(r"([^\s=/\"'>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
_WHITE = " \t\n\f\r"
_SPACE = re.compile(rf"[{_WHITE}]+")
_CSS_NOISE = re.compile(r"/\*.*?(?:\*/|\Z)|<!--|-->", re.S)
_CSS_STRING = re.compile(r"\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'", re.S)
_NAME = r"(?:[\w-]|\\.)+"
_COMPOUND = re.compile(rf"(\*|[a-z][a-z0-9-]*)?((?:[.#]{_NAME})*)\Z", re.I)
_PART = re.compile(rf"([.#])({_NAME})")
_GROUP = re.compile(r"\([^()]*\)|\[[^\]]*\]")
#: Selectors of what is no element, or of states that a page at rest is not in.
_ELSEWHERE = re.compile(r"::|:(?:before|after|first-line|first-letter|hover|active|focus|focus-within|focus-visible|target)(?![\w-])", re.I)
_PSEUDO = re.compile(r"(?<!\\):[\w-]+")
_COUNTED = re.compile(r"(#)[\w\\-]+|(\.)[\w\\-]+|(\[)[^\]]*|(?<!\\):([\w-]+)|([a-z][\w-]*)", re.I)
_OTHER_MEDIA = frozenset("print speech aural braille embossed handheld projection tty tv".split())
#: Blocks in blocks of a style sheet below this depth are not read.
NESTED = 16


class Node:
    __slots__ = ("tag", "attributes", "children")

    def __init__(self, tag: str, attributes: dict[str, str]):
        self.tag, self.attributes, self.children = tag, attributes, []


def attributes_of(source: str) -> dict[str, str]:
    out: dict[str, str] = {}
    for name, a, b, c in _ATTRIBUTE.findall(source):
        out.setdefault(name.lower(), entities.unescape(a or b or c))
    return out


def parse(page: str) -> Node:
    """The page's tree; the root is a node without tag."""
    root = Node("", {})
    stack = [root]

    def text(value: str) -> None:
        if stack[-1].tag == "head" and value.strip(_WHITE):
            stack.pop()  # its end tag and the body's start were left out
        if value:
            stack[-1].children.append(value)

    def close(names, stops) -> None:
        """Close the innermost open element of `names` with all inside it, unless one of `stops` is nearer."""
        for i in range(len(stack) - 1, 0, -1):
            if stack[i].tag in names:
                del stack[i:]
                return
            if stack[i].tag in stops:
                return

    at, n = 0, len(page)
    while at < n:
        m = _TOKEN.search(page, at)
        if not m:
            text(entities.unescape(page[at:]))
            break
        if m.start() > at:
            text(entities.unescape(page[at : m.start()]))
        at = m.end()
        tag = (m[2] or "").lower()
        if not tag:
            continue
        if m[1]:
            if tag == "br":
                stack[-1].children.append(Node("br", {}))
            elif tag == "p" and not any(x.tag == "p" for x in stack):
                stack[-1].children.append(Node("p", {}))
            elif tag in HEADINGS:
                close(HEADINGS, _SCOPE)
            elif tag not in ("html", "body"):  # text after their end still belongs to the page
                close({tag}, () if tag in ("table", "td", "th", "caption", "tr", "thead", "tbody", "tfoot", "template") else _SCOPE - {tag})
            continue
        if tag in CLOSES_P:
            close({"p"}, _SCOPE)
        if tag in HEADINGS and stack[-1].tag in HEADINGS:
            stack.pop()
        if tag in IMPLIED:
            kinds, stops = IMPLIED[tag]
            while True:
                size = len(stack)
                close(kinds, stops)
                if len(stack) == size:
                    break
        if tag in ("html", "body") and any(x.tag == tag for x in stack):
            continue
        if stack[-1].tag == "head" and tag not in NEVER:
            stack.pop()
        node = Node(tag, attributes_of(m[3]) if m[3].strip(" /\t\n\f\r") else {})
        stack[-1].children.append(node)
        if tag in RAW or tag in ESCAPABLE:
            end = re.compile(rf"</{tag}(?=[\s/>])[^>]*>?", re.I).search(page, at) if tag != "plaintext" else None
            body, at = (page[at : end.start()], end.end()) if end else (page[at:], n)
            if body:
                node.children.append(entities.unescape(body) if tag in ESCAPABLE else body)
        elif tag not in VOID:
            if len(stack) <= DEPTH:
                stack.append(node)
    return root


def _declared(style: str) -> dict[str, tuple[bool, str]]:
    """(is it important, value) of the declarations that decide on visibility; those that browsers would ignore are left out."""
    out: dict[str, tuple[bool, str]] = {}
    for part in style.lower().split(";"):
        name, _, value = part.partition(":")
        name, (value, mark, _) = name.strip(), value.partition("!")
        value = value.strip()
        if name == "display" and value or name == "visibility" and value in _VISIBILITY or name == "content-visibility" and value in ("hidden", "visible", "auto"):
            if mark or not out.get(name, (False,))[0]:
                out[name] = (bool(mark), value)
    return out


_VISIBILITY = frozenset("visible hidden collapse inherit initial unset revert".split())


def _on_screen(media: str) -> bool | None:
    """Does a media query list hold on a screen; None where it depends on the window."""
    said = []
    for part in media.lower().split(","):
        words = part.split()
        if words[:1] == ["only"]:
            words = words[1:]
        turned = words[:1] == ["not"]
        words = words[turned:]
        if not words or words[0] in ("all", "screen"):
            holds = True if len(words) < 2 else None
        else:
            holds = False if words[0] in _OTHER_MEDIA else None
        said.append(holds if holds is None or not turned else not holds)
    return True if True in said else None if None in said else False


def _rules(css: str, sure: bool, depth: int = 0) -> Iterator[tuple[str, str, bool]]:
    """(selectors, declarations, does it surely hold) of the rules that may hold on a screen, in order."""
    start = open_at = level = 0
    for m in re.finditer(r"[{};]", css):
        sign = m[0]
        if sign == "{":
            level += 1
            if level == 1:
                open_at = m.start()
        elif level == 0:
            start = m.end()
        elif sign == "}":
            level -= 1
            if level == 0:
                yield from _rule(css[start:open_at].strip(), css[open_at + 1 : m.start()], sure, depth)
                start = m.end()
    if level:  # the end of the sheet closes what is open
        yield from _rule(css[start:open_at].strip(), css[open_at + 1 :], sure, depth)


def _rule(prelude: str, body: str, sure: bool, depth: int) -> Iterator[tuple[str, str, bool]]:
    if not prelude.startswith("@"):
        yield prelude, body.split("{")[0] if "{" in body else body, sure
        return
    name = re.match(r"@[\w-]*", prelude)[0].lower()
    holds = _on_screen(prelude[6:]) if name == "@media" else True if name == "@layer" else None if name in ("@supports", "@container") else False
    if holds is not False and depth < NESTED:
        yield from _rules(body, sure and bool(holds), depth + 1)


class Sheet:
    """The page's rules on visibility, applied in the order of the cascade.

    Selectors are a tag, classes and ids, all of one element. Rules of other selectors, or under conditions that depend on the window, may
    show an element that they could hold for, but never hide one.
    """

    def __init__(self, root: Node):
        self.rules: dict[str, list[tuple]] = {}
        order = 0
        for node in self._styles(root):
            media = _on_screen(node.attributes.get("media", ""))
            if media is False:
                continue
            css = _CSS_STRING.sub('""', _CSS_NOISE.sub(" ", "".join(node.children)))
            for selectors, body, sure in _rules(css, bool(media)):
                said = _declared(body)
                if said:
                    order += 1
                    for s in re.split(r",(?![^()]*\))", selectors) if "(" in selectors else selectors.split(","):
                        self._add(s.strip(), said, sure, order)

    @staticmethod
    def _styles(root: Node) -> Iterator[Node]:
        todo = [root]
        while todo:
            node = todo.pop()
            if node.tag == "style":
                yield node
            todo += [c for c in reversed(node.children) if not isinstance(c, str)]

    def _add(self, selector: str, said: dict[str, tuple[bool, str]], sure: bool, order: int) -> None:
        m = _COMPOUND.match(selector) if selector else None
        if not m:
            bare, n = selector, 1
            while n:
                bare, n = _GROUP.subn("", bare)
            last = re.split(r"[\s>+~]+", bare)[-1]
            if not selector or _ELSEWHERE.search(bare):
                return
            m, sure = _COMPOUND.match(_PSEUDO.sub("", last)), False
            if not m:
                return
        if not sure:
            said = {k: v for k, v in said.items() if v[1] not in ("none", "hidden", "collapse", "inherit", "unset", "revert")}
        ids = classes = tags = 0
        for c in _COUNTED.finditer(selector):
            ids, classes, tags = ids + bool(c[1]), classes + bool(c[2] or c[3] or c[4]), tags + bool(c[5])
        tag = "" if m[1] in (None, "*") else m[1].lower()
        parts = [(sign, re.sub(r"\\(.)", r"\1", name)) for sign, name in _PART.findall(m[2])]
        key = "".join(parts[0]) if parts else tag or "*"
        if said:
            self.rules.setdefault(key, []).append((tag, parts, said, (ids, classes, tags, order)))

    def shown(self, node: Node, visible: bool) -> tuple[bool, bool]:
        """(is the element laid out, is its own text visible)."""
        tag, a = node.tag, node.attributes
        if tag in NEVER or tag == "input" and a.get("type", "").lower() == "hidden":
            return False, False
        display = "none" if "hidden" in a or tag == "dialog" and "open" not in a else ""
        if not self.rules and "style" not in a:
            return not display, visible and not display
        won: dict[str, tuple] = {"display": ((), display)}
        if self.rules:
            classes = a.get("class", "").split()
            for key in ("*", tag, *{"." + c for c in classes}, *(["#" + a["id"]] if "id" in a else [])):
                for own, parts, said, weight in self.rules.get(key, ()):
                    if (not own or own == tag) and all(name in classes if sign == "." else name == a.get("id") for sign, name in parts):
                        for name, (important, value) in said.items():
                            if name not in won or won[name][0] < (important, False, weight):
                                won[name] = ((important, False, weight), value)
        if "style" in a:
            for name, (important, value) in _declared(a["style"]).items():
                if name not in won or won[name][0] < (important, True, ()):
                    won[name] = ((important, True, ()), value)
        if won["display"][1] == "none" or "content-visibility" in won and won["content-visibility"][1] == "hidden":
            return False, False
        seen = won["visibility"][1] if "visibility" in won else "inherit"
        return True, visible if seen in ("inherit", "unset", "revert") else seen in ("visible", "initial")


class Flow:
    """Lines of text; `gap` blank lines are owed before the next one."""

    def __init__(self) -> None:
        self.lines: list[str] = []
        self.line: list[str] = []
        self.space = self.gap = False

    def inline(self, text: str) -> None:
        parts = _SPACE.split(text)
        for i, word in enumerate(parts):
            if i:
                self.space = bool(self.line)
            if word:
                if self.space:
                    self.line.append(" ")
                    self.space = False
                self.line.append(word)

    def verbatim(self, text: str) -> None:
        first, *more = text.split("\n")
        self.line.append(first)
        for x in more:
            self.newline()
            self.line.append(x)

    def newline(self) -> None:
        """End the line even if it is empty, unless nothing was written yet."""
        self._put("".join(self.line).rstrip(" "))

    def _put(self, line: str) -> None:
        if self.gap and self.lines and line:
            self.lines.append("")
        if line or self.lines:
            self.gap = self.gap and not line
            if line or not self.gap:
                self.lines.append(line)
        self.line, self.space = [], False

    def end(self, spaced: bool = False) -> None:
        """End of a block: close the line, owe a blank one."""
        if self.line:
            self.newline()
        self.space = False
        self.gap = self.gap or spaced

    def nested(self, lines: list[str]) -> None:
        self.end()
        for x in lines:
            self._put(x)

    def done(self) -> list[str]:
        self.end()
        while self.lines and not self.lines[-1]:
            self.lines.pop()
        return self.lines


class Renderer:
    def __init__(self, root: Node):
        self.sheet = Sheet(root)

    def children(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        for c in node.children:
            if isinstance(c, str):
                if visible:
                    if pre:
                        flow.verbatim(c)
                    else:
                        flow.inline(c)
                continue
            laid, seen = self.sheet.shown(c, visible)
            if laid:
                self.element(c, flow, seen, pre)

    def element(self, node: Node, flow: Flow, visible: bool, pre: bool) -> None:
        tag = node.tag
        if tag == "br":
            flow.newline()
        elif tag == "wbr":
            pass
        elif tag == "table":
            flow.end(True)
            flow.nested(self.table(node, visible))
            flow.end(True)
        elif tag in ("ul", "ol", "menu", "dir"):
            self.list(node, flow, visible)
        elif tag == "details" and "open" not in node.attributes:
            flow.end()
            for c in node.children:
                if not isinstance(c, str) and c.tag == "summary":
                    self.children(c, flow, visible, False)
                    break
            flow.end()
        elif tag in ("textarea", "pre", "listing"):
            flow.end(tag != "textarea")
            inner = Flow()
            if node.children and isinstance(node.children[0], str) and node.children[0].startswith("\n"):
                node.children[0] = node.children[0][1:]
            self.children(node, inner, visible, True)
            flow.nested(inner.done())
            flow.end(tag != "textarea")
        elif tag == "input":
            if visible and node.attributes.get("type", "text").lower() in ("submit", "reset", "button", "text", "search", "email", "url", "tel", "number"):
                flow.inline(node.attributes.get("value", ""))
        elif tag == "hr":
            flow.end(True)
        elif tag in BLOCK or tag in ("tr", "caption", "thead", "tbody", "tfoot"):
            flow.end(tag in SPACED)
            self.children(node, flow, visible, pre)
            flow.end(tag in SPACED)
        else:
            if tag in ("td", "th"):
                flow.inline(" ")
            self.children(node, flow, visible, pre)

    def list(self, node: Node, flow: Flow, visible: bool, _int=re.compile(r"\s*[+-]?\d{1,9}").match) -> None:
        inside = getattr(flow, "item", False)
        flow.end(not inside)
        number = int(m[0]) if (m := _int(node.attributes.get("start", ""))) else 1
        for c in node.children:
            if isinstance(c, str):
                if visible:
                    flow.inline(c)
                continue
            laid, seen = self.sheet.shown(c, visible)
            if not laid:
                continue
            if c.tag != "li":
                self.element(c, flow, seen, False)
                continue
            if node.tag == "ol" and (m := _int(c.attributes.get("value", ""))):
                number = int(m[0])
            mark = f"{number}. " if node.tag == "ol" else "- "
            number += 1
            inner = Flow()
            inner.item = True
            self.children(c, inner, seen, False)
            lines = inner.done()
            pad = " " * len(mark)
            if lines:
                flow.nested([mark + lines[0], *(pad + x if x else "" for x in lines[1:])])
        flow.end(not inside)

    def table(self, node: Node, visible: bool) -> list[str]:
        captions: list[str] = []
        rows: list[list[tuple[int, list[str]]]] = []
        held: dict[int, int] = {}  # columns that a cell of an earlier row still covers, and for how many rows

        def apart(of: Node, seen: bool) -> None:
            inner = Flow()
            self.element(of, inner, seen, False)
            captions.extend(inner.done())

        def holds_cells(of: Node) -> bool:
            return of.tag not in ("table", *NEVER) and any(not isinstance(c, str) and (c.tag in ("td", "th", "tr", "thead", "tbody", "tfoot") or holds_cells(c)) for c in of.children)

        def inside(of: Node, seen: bool) -> Iterator[tuple[Node, bool]]:
            """The cells of a row with whether they are visible, also those in elements that do not belong there; other text goes before the table."""
            for c in of.children:
                if isinstance(c, str):
                    if seen and c.strip(_WHITE):
                        captions.append(_SPACE.sub(" ", c).strip(_WHITE))
                    continue
                laid, own = self.sheet.shown(c, seen)
                if not laid:
                    continue
                if c.tag in ("td", "th"):
                    yield c, own
                elif holds_cells(c):
                    yield from inside(c, own)
                else:
                    apart(c, own)

        def row(tr: Node, seen_row: bool) -> None:
            cells, column = [], 0
            # this row takes up one row of each cell that reaches into it
            covered = {c for c, left in held.items() if left > 0}
            for c in covered:
                held[c] -= 1
            for td, seen in inside(tr, seen_row):
                while column in covered:
                    cells.append((1, []))
                    column += 1
                across, down = (min(max(int(td.attributes.get(k, "1")), 1), SPAN) if td.attributes.get(k, "1").strip().isdecimal() else 1 for k in ("colspan", "rowspan"))
                inner = Flow()
                self.children(td, inner, seen, False)
                cells.append((across, inner.done()))
                for k in range(column, column + across if down > 1 else column):
                    held[k] = down - 1
                column += across
            if cells:
                rows.append(cells)

        def part(of: Node, seen: bool) -> None:
            for c in of.children:
                if isinstance(c, str):
                    if seen and c.strip():
                        captions.append(_SPACE.sub(" ", c).strip())
                    continue
                laid, own = self.sheet.shown(c, seen)
                if not laid:
                    continue
                if c.tag == "tr":
                    row(c, own)
                elif c.tag in ("thead", "tbody", "tfoot"):
                    part(c, own)
                elif c.tag in ("td", "th"):
                    loose = Node("tr", {})
                    loose.children.append(c)
                    row(loose, seen)
                elif c.tag != "caption" and holds_cells(c):
                    part(c, own)
                elif c.tag not in ("colgroup", "col"):
                    apart(c, own)

        part(node, visible)
        width: dict[int, int] = {}
        for cells in rows:
            column = 0
            for across, lines in cells:
                if across == 1:
                    width[column] = max(width.get(column, 0), min(max(map(len, lines), default=0), PAD))
                column += across
        out = captions
        for cells in rows:
            if not any(lines for _, lines in cells):
                continue
            for i in range(max(len(lines) for _, lines in cells)):
                column, parts = 0, []
                for across, lines in cells:
                    room = sum(width.get(k, 0) for k in range(column, column + across)) + 3 * (across - 1)
                    parts.append((lines[i] if i < len(lines) else "").ljust(min(room, PAD * min(across, 4))))
                    column += across
                while parts and not parts[-1].strip():
                    parts.pop()
                out.append(" | ".join(parts).rstrip())
        return out


def render(page: str | None) -> str:
    """All visible text of the page."""
    if not page:
        return ""
    root, flow = parse(page), Flow()
    Renderer(root).children(root, flow, True, False)
    return "\n".join(flow.done())


def extracted(pages: DataFrame, html: str = "html", into: str = "text") -> DataFrame:
    """pages with the visible text in column `into`."""
    pages = pages.drop(into) if into in pages.columns and into != html else pages
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema), f"`{into}` string"])
    at = pages.columns.index(html)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in common.blocks(batch, _BLOCK_BYTES, html):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(list(map(render, part.column(at).to_pylist())), pa.string())], names=[*part.schema.names, into])

    return pages.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    rows = extracted(common.table(spark, sf_dir, "pages").select("page_id", "html"))
    return rows.select("page_id", "text", F.length("text").cast("long").alias("n_chars"), F.sha2("text", 256).alias("text_sha256"))

