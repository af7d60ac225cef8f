"""Find and replace by regex."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import INVALID_PATTERN, RinseError, first_line
from rinse.functions.regex_tree import required_text
from rinse.functions.text import literal_replacement
from rinse.operators.cells import Cell, Rule, clean_alike, present


def may_match(value: Column, pattern: str) -> Column | None:
    """Whether the text has the literal pieces every match needs; None if there are none."""
    tests = [value.contains(piece) for piece in required_text(pattern)]
    return reduce(Column.__and__, tests) if tests else None


def found(value: Column, pattern: str) -> Column:
    """Whether the pattern occurs in the text; looks for its literal pieces first."""
    possible = may_match(value, pattern)
    test = value.rlike(pattern)
    return test if possible is None else possible & test


def replacing(pattern: str, replacement: str) -> Rule:
    """Every match becomes the literal replacement. Hit: the *old* text had a match."""
    literal = literal_replacement(replacement)

    def rule(value: Column) -> Cell:
        text = F.regexp_replace(value, pattern, literal)
        possible = may_match(value, pattern)
        if possible is not None:
            text = F.when(possible, text).otherwise(value)
        # A changed text had a match. One that stayed the same had one only if what matched is
        # the replacement itself, so hardly any cell is searched twice.
        return Cell(text, (text != value) | (value.contains(replacement) & found(value, pattern)))

    return rule


def find_replace(
    df: DataFrame, columns: Iterable[str], pattern: str, replacement: str
) -> DataFrame:
    """Replace all matches in the columns and flag the rows that had any."""
    names = present(df, columns)
    check_java_pattern(df.sparkSession, pattern)
    return clean_alike(df, names, replacing(pattern, replacement))


def check_java_pattern(spark: SparkSession, pattern: str) -> None:
    """Fail now, not in the middle of a job, if Spark cannot compile the pattern."""
    try:
        spark.sql("SELECT '' RLIKE :pattern", args={"pattern": pattern}).collect()
    except PySparkException as error:
        message = f"Spark cannot use the pattern: {first_line(error)}"
        raise RinseError(INVALID_PATTERN, message) from error
