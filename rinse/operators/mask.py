"""Masking personal data, column by column."""

from __future__ import annotations

from collections.abc import Callable, Collection, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame

from rinse.errors import INVALID_SPEC, RinseError
from rinse.functions import masks
from rinse.operators.cells import Cell, Rule, clean

# The kinds of personal data.
KINDS = ("email", "phone", "person_name", "credit_card", "identifier", "address", "other")

# What is done for a kind, and its level. Of the kinds a column holds only those of the highest
# level act, in this order; the end of a card number looks like a phone number, so cards lead.
_MASKS = {
    "identifier": (2, masks.redact),
    "address": (2, masks.redact),
    "other": (2, masks.redact),
    "person_name": (1, masks.initials),
    "credit_card": (0, masks.mask_card),
    "phone": (0, masks.mask_phone),
    "email": (0, masks.mask_email),
}
IN_TEXT = [kind for kind, (level, _) in _MASKS.items() if level == 0]


def _steps(kinds: Collection[str]) -> list[Callable[[Column], Column]]:
    """The masks that act on a column with these kinds, each once."""
    highest = max((_MASKS[kind][0] for kind in kinds), default=0)
    acting = (step for kind, (level, step) in _MASKS.items() if kind in kinds and level == highest)
    return list(dict.fromkeys(acting))


def masking(kinds: Collection[str]) -> Rule:
    """One mask for a column that holds these kinds. Hit: the text changed.

    A kind that takes the whole value beats a name, and a name beats what occurs in text.
    """
    unknown = sorted(set(kinds) - set(KINDS))
    if unknown:
        raise RinseError(INVALID_SPEC, f"Unknown kind of data: {', '.join(unknown)}", unknown)

    steps = _steps(kinds)

    def rule(value: Column) -> Cell:
        text = reduce(lambda text, step: step(text), steps, value)
        return Cell(text, text != value)

    return rule


def mask(df: DataFrame, kinds_by_column: Mapping[str, Collection[str]]) -> DataFrame:
    """Mask each column for the kinds it holds and flag the rows that changed."""
    return clean(df, {name: masking(kinds) for name, kinds in kinds_by_column.items()})
