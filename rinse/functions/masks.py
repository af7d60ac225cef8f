"""Masks for personal data as plain column functions. Null stays null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What counts as a card number, phone number, e-mail address and name.
CARD = r"\b(?:\d[ -]?){12,15}(\d{4})\b"
PHONE = r"(?:\+?\d{1,3}[\s.-]?)?\(?\d{3}\)?[\s.-]?\d{3}[\s.-]?(\d{4})\b"
EMAIL = r"([A-Za-z0-9._%+-])[A-Za-z0-9._%+-]*(@[A-Za-z0-9.-]+\.[A-Za-z]{2,})"
NAME = r"(\p{L})[\p{L}'’-]*"
REDACTED = "[REDACTED]"

# What every card and phone number ends in, tried first: most text has nothing like it, and it
# is quick to rule out. A text has a phone number exactly if it has the end of one.
_CARD_END = r"\d[ -]?\d{4}\b"
_PHONE_END = r"\d{3}\)?[\s.-]?\d{3}[\s.-]?\d{4}\b"
_CARD_LENGTH = 16
_PHONE_LENGTH = 10


def may_have_card(value: Column) -> Column:
    return (F.length(value) >= _CARD_LENGTH) & value.rlike(_CARD_END)


def has_card(value: Column) -> Column:
    return may_have_card(value) & value.rlike(CARD)


def has_phone(value: Column) -> Column:
    return (F.length(value) >= _PHONE_LENGTH) & value.rlike(_PHONE_END)


def has_email(value: Column) -> Column:
    return value.contains("@") & value.rlike(EMAIL)


def mask_card(value: Column) -> Column:
    """Keep the last four digits of every card number in the text."""
    masked = F.regexp_replace(value, CARD, "**** **** **** $1")
    return F.when(may_have_card(value), masked).otherwise(value)


def mask_phone(value: Column) -> Column:
    """Keep the last four digits of every phone number in the text."""
    masked = F.regexp_replace(value, PHONE, "***-***-$1")
    return F.when(has_phone(value), masked).otherwise(value)


def mask_email(value: Column) -> Column:
    """Keep the first character and the domain of every e-mail address in the text."""
    masked = F.regexp_replace(value, EMAIL, "$1***$2")
    return F.when(value.contains("@"), masked).otherwise(value)


def initials(value: Column) -> Column:
    """Reduce every word to its first letter and a dot."""
    return F.regexp_replace(value, NAME, "$1.")


def redact(value: Column) -> Column:
    """Replace the whole value, the empty one too."""
    return F.when(value.isNotNull(), F.lit(REDACTED))
