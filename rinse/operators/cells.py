"""Rewriting text columns in place, with one match flag per row.

A *rule* turns the old text of a cell into a :class:`Cell`: the new text and whether the rule
recognised the old one. ``clean`` applies any set of rules, one per column, as a single
projection, so it costs no shuffle and works on batch and streaming frames alike.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rinse.errors import COLUMN_NOT_FOUND, RESERVED_COLUMN, RinseError

ROW_ID = "__row_id"
MATCHED = "__matched"
RESERVED = (ROW_ID, MATCHED)


@dataclass(frozen=True)
class Cell:
    text: Column
    hit: Column


Rule = Callable[[Column], Cell]


def named(name: str) -> Column:
    """A top-level column by its literal name: dots, spaces and backticks mean nothing."""
    escaped = name.replace("`", "``")
    return F.col(f"`{escaped}`")


def present(df: DataFrame, names: Iterable[str]) -> list[str]:
    """``names`` once each, in order; fails without running a job if one is not a user column."""
    wanted = list(dict.fromkeys(names))
    usable = [name for name in df.columns if name not in RESERVED]
    absent = [name for name in wanted if name not in usable]
    if absent:
        raise RinseError(COLUMN_NOT_FOUND, f"No such column: {', '.join(absent)}", absent)
    return wanted


def clean(df: DataFrame, rules: Mapping[str, Rule]) -> DataFrame:
    """Apply each column's rule where the column stands and append the row's match flag."""
    if MATCHED in df.columns:
        raise RinseError(RESERVED_COLUMN, f"The table already has a column {MATCHED}", [MATCHED])
    cells = {name: rules[name](named(name).cast("string")) for name in present(df, rules)}
    # greatest() skips nulls, so an unknown hit counts as none and the flag is never null.
    hits = [cell.hit for cell in cells.values()]
    flag = F.greatest(F.lit(False), *hits) if hits else F.lit(False)
    return df.withColumns({**{name: cell.text for name, cell in cells.items()}, MATCHED: flag})


def clean_alike(df: DataFrame, columns: Iterable[str], rule: Rule) -> DataFrame:
    """The same rule on several columns."""
    return clean(df, dict.fromkeys(columns, rule))


def user_columns(df: DataFrame) -> DataFrame:
    """The table as its owner knows it, without the technical columns."""
    return df.drop(*RESERVED)


def with_row_id(df: DataFrame) -> DataFrame:
    """Put an increasing id in front, without a shuffle. Only for a table as it was read."""
    taken = [name for name in df.columns if name in RESERVED]
    if taken:
        raise RinseError(RESERVED_COLUMN, f"Reserved column names: {', '.join(taken)}", taken)
    return df.select(F.monotonically_increasing_id().alias(ROW_ID), "*")
