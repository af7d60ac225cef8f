"""A small tree of a regular expression, for questions about its shape.

It covers the syntax Java and Python share. Callers that need more certainty compile the
pattern as well; :func:`required_text` gives up on anything it does not know for sure.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

_TOKENS = re.compile(
    r"""
      (?P<set>    \[\^?\]?(?:\\.|[^\]\\])*\] )
    | (?P<odd>    \(\?(?:P|\(|\#|<(?![=!])) )
    | (?P<flags>  \(\?[A-Za-z]+\) )
    | (?P<open>   \((?:\?(?:<[=!]|[=!>]|[A-Za-z]*(?:-[A-Za-z]+)?:))? )
    | (?P<close>  \) )
    | (?P<bar>    \| )
    | (?P<times>  (?:[*+?]|\{\d+(?:,\d*)?\}|\{,\d+\})[?+]? )
    | (?P<edge>   [\^$]|\\[bBAZz] )
    | (?P<group>  \\[1-9]\d? )
    | (?P<char>   \\x[0-9A-Fa-f]{2}|\\u[0-9A-Fa-f]{4}|\\.|. )
    """,
    re.VERBOSE | re.DOTALL,
)


@dataclass(frozen=True)
class One:
    """One character out of a set, kept as written."""

    token: str


@dataclass(frozen=True)
class Row:
    """Parts one after the other. ``atomic`` parts are never given back once matched."""

    parts: tuple
    atomic: bool = False


@dataclass(frozen=True)
class Choice:
    options: tuple


@dataclass(frozen=True)
class Repeat:
    part: object
    low: int
    high: int | None
    atomic: bool


@dataclass(frozen=True)
class Nothing:
    """Takes no text: an anchor, or a look-around with ``inner``."""

    inner: object = None


def tokens(pattern: str) -> list[tuple[str, str]]:
    return [(found.lastgroup, found.group()) for found in _TOKENS.finditer(pattern)]


@lru_cache(maxsize=4096)
def tree(pattern: str):
    """The pattern as nested nodes. The pattern must compile; brackets are taken to balance."""
    open_groups: list[tuple[str, list[list]]] = [("", [[]])]
    for kind, text in tokens(pattern):
        here = open_groups[-1][1]
        if kind in ("open", "odd"):
            open_groups.append((text, [[]]))
        elif kind == "close":
            opener, options = open_groups.pop()
            open_groups[-1][1][-1].append(_group(opener, options))
        elif kind == "bar":
            here.append([])
        elif kind == "times":
            here[-1].append(_repeat(here[-1].pop(), text))
        elif kind == "edge":
            here[-1].append(Nothing())
        elif kind in ("set", "char"):
            here[-1].append(One(text))
        elif kind == "group":
            here[-1].append(One("."))
    return _group("", open_groups[0][1])


def _group(opener: str, options: list[list]):
    rows = tuple(Row(tuple(parts)) for parts in options)
    inner = rows[0] if len(rows) == 1 else Choice(rows)
    if opener in ("(?=", "(?!", "(?<=", "(?<!"):
        return Nothing(inner)
    return Row((inner,), atomic=True) if opener == "(?>" else inner


def _repeat(part, text: str) -> Repeat:
    atomic = len(text) > 1 and text.endswith("+")
    if text[0] == "{":
        low, comma, high = text[1 : text.index("}")].partition(",")
        low, high = int(low or 0), (int(high) if high else None) if comma else int(low)
    else:
        low, high = {"*": (0, None), "+": (1, None), "?": (0, 1)}[text[0]]
    return Repeat(part, low, high, atomic)


# Syntax in which Java could read a character differently than the tree does.
_UNSURE = re.compile(r"\\[A-Za-z0-9](?<![dDwWsSbB])|\(\?(?![:=!>]|<[=!])|\[\^?\]|\[(?:\\.|[^\]\\])*\[")


@lru_cache(maxsize=4096)
def required_text(pattern: str) -> tuple[str, ...]:
    """Pieces of literal text that occur in everything the pattern matches, perhaps none.

    Looking for them first is far cheaper than running the pattern on every cell.
    """
    if _UNSURE.search(pattern) or "{" in re.sub(r"\\.|\{\d+(?:,\d*)?\}", "", pattern):
        return ()
    try:
        re.compile(pattern)
    except re.error:
        return ()
    pieces = [""]
    _collect(tree(pattern), pieces)
    return tuple(dict.fromkeys(piece for piece in pieces if piece))


def _collect(node, pieces: list[str]) -> None:
    """Extend the last piece while literals follow each other; start a new one otherwise."""
    if isinstance(node, One) and (len(node.token) == 1 and node.token != "."):
        pieces[-1] += node.token
    elif isinstance(node, One) and re.fullmatch(r"\\[^A-Za-z0-9]", node.token):
        pieces[-1] += node.token[1]
    elif isinstance(node, Row):
        for part in node.parts:
            _collect(part, pieces)
    elif not isinstance(node, Nothing):
        pieces.append("")
        if isinstance(node, Repeat) and node.low > 0:
            _collect(node.part, pieces)
            pieces.append("")
