"""Pages as trees of block elements and blocks of text.

A block is the text between two block tags; inline tags, comments and references within it
are resolved, white space becomes one space. Unclosed paragraphs, list items and cells end
where HTML ends them, stray end tags are ignored, and a page that breaks off is read as far
as it goes.
"""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

# Names of HTML elements, by how they are read: fixed values.
INLINE = frozenset("a abbr acronym b bdi bdo big br cite code data del dfn em font i img input ins kbd label mark nobr q rb rp rt ruby s samp small span strike strong sub sup time tt u var wbr".split())
VOID = frozenset("area base basefont br col embed frame hr img input link meta param source track wbr".split())
RAW = frozenset("iframe noembed noframes noscript script style textarea title xmp".split())
HEAD = frozenset("base link meta noscript script style template title".split())
SILENT = frozenset("audio canvas datalist head map object select svg template video".split())
_FLOWING = INLINE | RAW | SILENT - {"head"}  # those that don't end a block
#: An open element that ends where another begins, and those that it doesn't reach beyond.
ENDS = {
    "li": ({"li"}, {"ul", "ol", "menu"}),
    "dt": ({"dt", "dd"}, {"dl"}),
    "dd": ({"dt", "dd"}, {"dl"}),
    "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}),
    "th": ({"td", "th"}, {"tr", "table"}),
}

_TOKEN = re.compile(
    r"""<!--.*?(?:-->|\Z)|<(/?)([a-zA-Z][^\s/>]*)((?:[^>"']|"[^"]*"|'[^']*')*+)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>|<[!?/][^>]*>|<[a-zA-Z!?/][^>]*\Z""",
    re.S,
)
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]+)(?:\s*=\s*("[^"]*"|'[^']*'|[^\s"'>]+))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_RAW_END = {name: re.compile(rf"</{name}(?=[\s/>]|\Z)", re.I) for name in RAW}
MARK = "data-main"  # 1 or 0 on an element of a labelled page: whether it and what is below is main text


@dataclass
class Tree:
    """Nodes in page order: the root, block elements and blocks of text (leaves)."""

    parent: list[int] = field(default_factory=lambda: [-1])
    depth: list[int] = field(default_factory=lambda: [0])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [("root",)])  # what the element is called, of leaves empty
    text: list[str | None] = field(default_factory=lambda: [None])  # of leaves
    linked: list[int] = field(default_factory=lambda: [0])  # of leaves: characters within links
    main: list[bool] = field(default_factory=lambda: [False])  # by the marks of a labelled page

    def add(self, parent: int, names: tuple[str, ...], text: str | None, linked: int, main: bool) -> int:
        self.parent.append(parent)
        self.depth.append(self.depth[parent] + 1)
        self.names.append(names)
        self.text.append(text)
        self.linked.append(linked)
        self.main.append(main)
        return len(self.parent) - 1


@dataclass
class _Open:
    name: str
    node: int
    link: bool
    silent: bool
    main: bool


def _described(name: str, attributes: str) -> tuple[tuple[str, ...], str | None]:
    """An element's tag, the words of its class, id and role, and whether it is hidden; and its mark."""
    if not attributes or attributes.isspace():
        return (f"<{name}>",), None
    out, mark = [f"<{name}>"], None
    for m in _ATTRIBUTE.finditer(attributes):
        key, value = m[1].lower(), html.unescape(m[2] or "").strip("\"'")
        if key in ("class", "id", "role"):
            out += [w.lower() for w in _NAME.findall(value)]
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            out.append("(hidden)")
        elif key == MARK:
            mark = value
    return tuple(dict.fromkeys(out)), mark


def _close(stack: list[_Open], ends: set[str], stops: set[str]) -> None:
    """Close the innermost open element of `ends` that isn't beyond one of `stops`, with all within."""
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name in ends:
            del stack[k:]
            return
        if stack[k].name in stops:
            return


def _close_paragraph(stack: list[_Open]) -> None:
    for k in range(len(stack) - 1, 0, -1):
        if stack[k].name == "p":
            del stack[k:]
            return
        if stack[k].name not in INLINE:
            return


def parse(page: str) -> Tree:
    tree = Tree()
    stack = [_Open("", 0, False, False, False)]
    pieces: list[str] = []
    linked = 0

    def flush() -> None:
        nonlocal linked
        if pieces:
            text = " ".join("".join(pieces).split())
            if text:
                top = stack[-1]
                tree.add(top.node, (), text, min(linked, len(text)), top.main)
            pieces.clear()
        linked = 0

    def say(text: str) -> None:
        nonlocal linked
        top = stack[-1]
        if text and not top.silent:
            text = html.unescape(text) if "&" in text else text
            pieces.append(text)
            if top.link:
                linked += len(text.strip())

    at, search = 0, _TOKEN.search
    while m := search(page, at):
        if m.start() > at:
            say(page[at : m.start()])
        at = m.end()
        name = m[2] or m[5]
        if not name:
            continue
        name = name.lower()
        inline, breaks = name in INLINE, name not in _FLOWING
        if m[1] or m[4]:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k].name == name:
                    if breaks and not stack[k].silent:
                        flush()
                    del stack[k:]
                    break
                if inline and stack[k].name not in INLINE:
                    break
            continue
        if breaks and not stack[-1].silent:
            flush()
        attributes = m[3] if m[2] else m[6]
        if name == "br":
            say(" ")
        if name in RAW:
            end = _RAW_END[name].search(page, at)
            at = end.start() if end else len(page)
        if name in VOID or name in RAW:
            continue
        if stack[-1].name == "head" and name not in HEAD:
            stack.pop()
        if breaks and not stack[-1].silent:
            _close_paragraph(stack)
            if name in ENDS:
                _close(stack, *ENDS[name])
        top = stack[-1]
        names, mark = ((), None) if inline else _described(name, attributes)
        main = top.main if mark is None else mark == "1"
        node = top.node if inline or top.silent or name in SILENT else tree.add(top.node, names, None, 0, main)
        if not (attributes.endswith("/") and name in SILENT):
            stack.append(_Open(name, node, top.link or name == "a", top.silent or name in SILENT, main))
    if at < len(page):
        say(page[at:])
    flush()
    return tree
