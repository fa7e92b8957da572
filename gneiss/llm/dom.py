"""A tolerant reading of HTML into arrays of nodes, parents before children."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field
from functools import lru_cache

# Fixed values of the HTML standard.
VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style noscript noframes noembed iframe xmp template textarea title".split())
CLOSES_P = frozenset(
    "address article aside blockquote center details dialog dir div dl fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr main menu nav ol p pre search section summary table ul".split()
)
BLOCKS = CLOSES_P | frozenset("html head body title br li dt dd tr td th thead tbody tfoot caption option optgroup select button textarea label legend video audio canvas iframe noscript".split())
#: An open element of the first kind ends when one of the second begins, unless one of the third lies between.
IMPLIED = {
    "li": (("li",), ("ul", "ol", "menu")),
    "dt": (("dt", "dd"), ("dl",)),
    "dd": (("dt", "dd"), ("dl",)),
    "tr": (("tr",), ("table", "thead", "tbody", "tfoot")),
    "td": (("td", "th"), ("tr", "table")),
    "th": (("td", "th"), ("tr", "table")),
    "thead": (("thead", "tbody", "tfoot"), ("table",)),
    "tbody": (("thead", "tbody", "tfoot"), ("table",)),
    "tfoot": (("thead", "tbody", "tfoot"), ("table",)),
    "option": (("option",), ("select", "datalist")),
    "body": (("head",), ()),
}
_FENCE = ("table", "td", "th", "caption", "button", "object", "template")

_TOKEN = re.compile(
    r"<!--(?:-?>|.*?(?:--!?>|\Z))"
    r"|<(/?)([a-zA-Z][^\s/>]*)((?:[^>=]++|=\s*+(?:\"[^\"]*+\"|'[^']*+'|))*+)>"
    r"|<[!?/][^>]*(?:>|\Z)|<[a-zA-Z][^>]*\Z",
    re.S,
)
_ATTRIBUTE = re.compile(r"(?<![^\s\"'/])(class|id|role|hidden|style|data-main)(?:\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+))?", re.I)
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Dom:
    """Nodes in page order. A text node has the tag #text; `block` differs between texts that a block boundary parts."""

    parent: list[int] = field(default_factory=list)
    tag: list[str] = field(default_factory=list)
    names: list[tuple[str, ...]] = field(default_factory=list)  # parts of class, id and role
    text: list[str] = field(default_factory=list)
    block: list[int] = field(default_factory=list)
    mark: list[bool | None] = field(default_factory=list)  # data-main of labelled pages

    def add(self, parent: int, tag: str, names: tuple[str, ...], text: str, block: int, mark: bool | None) -> int:
        self.parent.append(parent)
        self.tag.append(tag)
        self.names.append(names)
        self.text.append(text)
        self.block.append(block)
        self.mark.append(mark)
        return len(self.tag) - 1


@lru_cache(maxsize=4096)
def attributes(raw: str) -> tuple[tuple[str, ...], bool | None]:
    """(parts of class, id and role in lower case, data-main) of a tag's attributes."""
    parts, mark = [], None
    for name, value in _ATTRIBUTE.findall(raw):
        name, value = name.lower(), html.unescape(value.strip("\"'"))
        if name == "data-main":
            mark = value == "1"
        elif name == "hidden":
            parts.append("hidden")
        elif name == "style":
            parts += ["hidden"] if re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I) else []
        else:
            parts += [p.lower() for p in _PARTS.findall(value)]
    return tuple(dict.fromkeys(parts)), mark


def parse(page: str) -> Dom:
    """The nodes of a page under a root of its own, without void elements, script, style and the like; character references are decoded."""
    dom = Dom()
    dom.add(-1, "#page", (), "", 0, None)
    stack = [0]
    opened: dict[str, int] = {}
    block = 0

    def text(raw: str) -> None:
        if raw:
            dom.add(stack[-1], "#text", (), html.unescape(raw) if "&" in raw else raw, block, None)

    def close(upto: int) -> None:
        for node in stack[upto:]:
            opened[dom.tag[node]] -= 1
        del stack[upto:]

    def last(kinds: tuple[str, ...], fence: tuple[str, ...]) -> int | None:
        if not any(opened.get(k) for k in kinds):
            return None
        for i in range(len(stack) - 1, 0, -1):
            tag = dom.tag[stack[i]]
            if tag in kinds:
                return i
            if tag in fence:
                return None
        return None

    at = 0
    while True:
        found = _TOKEN.search(page, at)
        if not found:
            text(page[at:])
            return dom
        text(page[at : found.start()])
        at = found.end()
        tag = found.group(2)
        if tag is None:
            continue
        tag = tag.lower()
        block += tag in BLOCKS
        if found.group(1):
            upto = last((tag,), ())
            if upto is not None:
                close(upto)
            continue
        for kinds, fence in (*([(("p",), _FENCE)] if tag in CLOSES_P else []), *([IMPLIED[tag]] if tag in IMPLIED else [])):
            upto = last(kinds, fence)
            if upto is not None:
                close(upto)
        if tag in VOID:
            continue
        end = re.compile(rf"</{tag}(?=[\s/>])", re.I).search(page, at) if tag in RAW else None
        if tag in RAW and tag not in ("textarea", "title"):
            at = end.start() if end else len(page)
            continue
        names, mark = attributes(found.group(3))  # a closing slash means nothing in HTML
        stack.append(dom.add(stack[-1], tag, names, "", block, mark))
        opened[tag] = opened.get(tag, 0) + 1
        if tag in RAW:
            text(page[at : end.start() if end else len(page)])
            at = end.start() if end else len(page)
            close(len(stack) - 1)
