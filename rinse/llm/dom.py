"""Pages of HTML as trees of block elements and the runs of text in them."""

from __future__ import annotations

import html
import re
from dataclasses import dataclass, field

INLINE = frozenset(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i img ins kbd mark nobr q rp rt ruby s samp small "
    "span strike strong sub sup time tt u var wbr".split()
)
EMPTY = frozenset("area base basefont bgsound col embed frame hr input link meta param source track".split())
RAW = frozenset("script style textarea title xmp iframe noembed noframes".split())  # no markup inside
HIDDEN = frozenset("template noscript select datalist svg object canvas audio video".split())  # text is not shown
FRAME = frozenset(("html", "head", "body"))  # often left out, so never nodes
WITHIN_P = frozenset("button label select svg noscript object template canvas audio video output progress meter".split())
CLOSED_BY_ITS_LIKE = {
    "li": ("li",), "dt": ("dt", "dd"), "dd": ("dt", "dd"), "tr": ("td", "th", "tr"), "td": ("td", "th"),
    "th": ("td", "th"), "option": ("option",), "tbody": ("td", "th", "tr", "thead", "tbody"),
    "tfoot": ("td", "th", "tr", "tbody"),
}

_MARK = re.compile(r"<(?=[a-zA-Z/!?])")
_TAG = re.compile(r"""<(/?)([a-zA-Z][^\s/>]*+)((?:[^>"']++|"[^"]*+"|'[^']*+')*+)>""")
_ATTRIBUTE = re.compile(r"""([^\s=/"'>]++)(?:\s*+=\s*+("[^"]*+"|'[^']*+'|[^\s"'>]++))?""")
_NAME = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")
_NO_DISPLAY = re.compile(r"display\s*:\s*none", re.IGNORECASE)


@dataclass
class Tree:
    """Nodes in page order, parents first; node 0 stands for the page.

    A node is an element or a run of text. ``tags`` has an element's name, '' for text; ``names`` the
    words of an element's class, id and role; ``texts`` a run's text with its white space reduced;
    ``linked`` how many of a run's characters are links; ``labels`` what ``data-label`` says, if
    anything.
    """

    parents: list[int] = field(default_factory=lambda: [-1])
    tags: list[str] = field(default_factory=lambda: ["#page"])
    names: list[tuple[str, ...]] = field(default_factory=lambda: [()])
    texts: list[str] = field(default_factory=lambda: [""])
    linked: list[int] = field(default_factory=lambda: [0])
    labels: list[str | None] = field(default_factory=lambda: [None])

    def add(self, parent: int, tag: str, names: tuple[str, ...] = (), text: str = "", linked: int = 0, label: str | None = None) -> int:
        for column, value in zip(
            (self.parents, self.tags, self.names, self.texts, self.linked, self.labels),
            (parent, tag, names, text, linked, label), strict=True,
        ):
            column.append(value)
        return len(self.parents) - 1


def _attributes(rest: str) -> dict[str, str]:
    return {name.lower(): value.strip("\"'") for name, value in _ATTRIBUTE.findall(rest)}


def parse(page: str) -> Tree:
    """The tree of a page; an unfinished tag, comment or script at its end is left out, as browsers do."""
    tree = Tree()
    stack: list[tuple[str, int, bool]] = [("#page", 0, True)]  # name, node, whether its text is shown
    opened: dict[str, int] = {}
    run: list[str] = []
    linked, in_link = 0, False
    at = 0

    def text(piece: str) -> None:
        nonlocal linked
        if piece and stack[-1][2]:
            decoded = html.unescape(piece)
            run.append(decoded)
            linked += len(decoded) if in_link else 0

    def flush() -> None:
        nonlocal linked
        if run:
            whole = " ".join("".join(run).split())
            if whole:
                tree.add(stack[-1][1], "", text=whole, linked=min(linked, len(whole)))
            run.clear()
        linked = 0

    def pop() -> None:
        flush()
        opened[stack.pop()[0]] -= 1

    while mark := _MARK.search(page, at):
        start = mark.start()
        text(page[at:start])
        if page.startswith("<!--", start):
            end = page.find("-->", start + 2)
            at = end + 3 if end >= 0 else len(page)
            continue
        if page[start + 1] in "!?" or page[start + 1] == "/" and not page[start + 2 : start + 3].isalpha():
            end = page.find(">", start)
            at = end + 1 if end >= 0 else len(page)
            continue
        tag = _TAG.match(page, start)
        if not tag:
            at = len(page)
            break
        at, name = tag.end(), tag[2].lower()
        if name == "a":
            in_link = not tag[1]
        if name == "br":
            text(" ")
        elif tag[1]:
            if opened.get(name):
                while stack[-1][0] != name:
                    pop()
                pop()
        elif name in RAW:
            flush()
            end = re.compile(f"</{re.escape(name)}(?=[\\s/>])[^>]*>?", re.IGNORECASE).search(page, at)
            at = end.end() if end else len(page)
        elif name in EMPTY:
            flush()
        elif name not in FRAME:
            rest = tag[3]
            found = _attributes(rest) if rest and not rest.isspace() else {}
            shown = "hidden" not in found and not _NO_DISPLAY.search(found.get("style", ""))
            if name in INLINE and shown:
                continue
            flush()
            if stack[-1][0] == "p" and name not in WITHIN_P and name not in INLINE:
                pop()
            while stack[-1][0] in CLOSED_BY_ITS_LIKE.get(name, ()):
                pop()
            words = " ".join(found[key] for key in ("class", "id", "role") if key in found)
            names = tuple(word.lower() for word in _NAME.findall(words))
            node = tree.add(stack[-1][1], name, names, label=found.get("data-label"))
            shown = shown and name not in HIDDEN and stack[-1][2]
            if not rest.endswith("/") or name not in HIDDEN:
                stack.append((name, node, shown))
                opened[name] = opened.get(name, 0) + 1
    text(page[at:])
    flush()
    return tree
