"""Vetted patterns by name, inline flags, and text every match of a pattern must contain."""

from __future__ import annotations

from rinse.errors import INVALID_PATTERN, RinseError

# Patterns in the common subset of Java and Python syntax.
_DAY, _MONTH, _YEAR = r"(?:0[1-9]|[12]\d|3[01])", r"(?:0[1-9]|1[0-2])", r"(?:19|20)\d{2}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_LABEL = r"[A-Za-z\d](?:[A-Za-z\d-]{0,61}[A-Za-z\d])?"
NAMED_PATTERNS = {
    "email": rf"\b[A-Za-z\d][A-Za-z\d._%+-]{{0,63}}@(?:{_LABEL}\.)+[A-Za-z]{{2,24}}\b",
    "us_phone": r"(?:\+?1[ .-]?)?(?:\(\d{3}\) ?|\b\d{3}[ .-]?)\d{3}[ .-]?\d{4}\b",
    "iso_date": rf"\b{_YEAR}-{_MONTH}-{_DAY}\b",
    "iso_or_dmy_date": rf"\b(?:{_YEAR}-{_MONTH}-{_DAY}|{_DAY}/{_MONTH}/{_YEAR})\b",
    "ipv4": rf"\b{_OCTET}(?:\.{_OCTET}){{3}}\b",
    "url": rf"\bhttps?://(?:{_LABEL}\.)+[A-Za-z]{{2,24}}(?::\d{{1,5}})?(?:[/?#][^\s\"'<>]*)?",
    "uuid": r"\b[\da-f]{8}(?:-[\da-f]{4}){3}-[\da-f]{12}\b",
}


def pattern(name: str) -> str:
    if name not in NAMED_PATTERNS:
        raise RinseError(INVALID_PATTERN, f"No pattern is called {name!r}", [name])
    return NAMED_PATTERNS[name]


def word(text: str) -> str:
    """The pattern of one standalone word (letters, digits, ``_`` and spaces), in any case."""
    if not text.replace("_", "").replace(" ", "").isalnum():
        raise RinseError(INVALID_PATTERN, f"Not a word: {text!r}", [text])
    return with_flags(rf"\b{text}\b", ignore_case=True)


def with_flags(
    body: str, *, ignore_case: bool = False, multiline: bool = False, dotall: bool = False
) -> str:
    """Put the chosen flags in front of the pattern, always in the order i, m, s."""
    letters = "i" * ignore_case + "m" * multiline + "s" * dotall
    return f"(?{letters}){body}" if letters else body
