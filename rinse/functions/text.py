"""Column functions on plain text."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: the characters that count as white space, information separators included.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006"
    "\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)


def strip(value: Column) -> Column:
    """Remove white space of any kind at both ends (``trim`` only knows the space)."""
    return F.btrim(value, F.lit(WHITE_SPACE))


def squeeze(value: Column) -> Column:
    """Strip, and reduce every inner run of white space to one space. Case is kept."""
    return F.trim(F.regexp_replace(value, f"[{WHITE_SPACE}]+", " "))


def literal_replacement(text: str) -> str:
    """``text`` as a replacement string in which ``$`` and backslash stand for themselves."""
    return re.sub(r"[\\$]", r"\\\g<0>", text)


def literal_replacement_of(value: Column) -> Column:
    """The same escape for a column of replacements."""
    return F.regexp_replace(value, r"[\\$]", r"\\$0")


def fingerprint(namespace: str, *parts: Column) -> Column:
    """A key over all parts; any change in a part or in the namespace changes it."""
    return F.concat(F.lit(f"{namespace}:"), F.sha2(F.concat_ws("\x1f", *parts), 256))


def samples_text(samples: Column) -> Column:
    """``array<struct<column,values>>`` as JSON that does not depend on the column order."""
    return F.to_json(F.array_sort(samples))
