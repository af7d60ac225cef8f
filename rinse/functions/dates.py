"""Reading dates written in several formats."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

_PIECES = re.compile(r"'(?:[^']|'')*'|([A-Za-z])\1*|.", re.DOTALL)
# Digits are taken once and not given back, so a text that does not fit is turned away in one pass.
_NUMBER = r"[+-]?\d++"
# Fixed value: the longest name a field has, "September".
_NAME = r"\D{1,9}"


def shape(date_format: str) -> str | None:
    """A regex that every text written in the format fits, or None where none is known.

    Parsing a date that does not fit costs an exception inside the parser; the regex turns
    most of those away first. It may let more through than the format does, never less.
    Number fields next to each other are one run of digits in it.
    """
    parts: list[str] = []
    for piece in _PIECES.finditer(date_format):
        text = piece.group()
        letter = piece.group(1)
        if letter is None:
            literal = text[1:-1].replace("''", "'") if len(text) > 1 else text
            if text == "'" or literal in ("", "[", "]", "{", "}", "#") or re.search(r"\d", literal):
                return None
            parts.append("".join(re.sub(r"([^A-Za-z0-9])", r"\\\1", c) for c in literal))
        elif letter in "ydHhms" or (letter == "M" and len(text) < 3):
            if parts[-1:] != [_NUMBER]:
                parts.append(_NUMBER)
        elif letter == "S":
            if parts[-1:] != [_NUMBER]:
                parts.append(_NUMBER)
        elif letter in "Ma":
            parts.append(_NAME)
        else:
            return None
    return "(?iu)^" + "".join(parts) + "$"


def read_date(value: Column, date_format: str) -> Column:
    """The date, or null where the text does not fit the format."""
    fits = shape(date_format)
    day = F.try_to_date(value, date_format)
    return F.when(value.rlike(fits), day) if fits else day


def first_date(value: Column, date_formats: Sequence[str]) -> Column:
    """The date by the first format that fits, after trimming spaces."""
    tidy = F.trim(value)
    return F.coalesce(*(read_date(tidy, date_format) for date_format in date_formats))
