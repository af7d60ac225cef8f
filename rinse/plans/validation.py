"""Checks on specifications as column expressions: null if all is well, else what is wrong."""

from __future__ import annotations

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

from rinse.errors import INVALID_PATTERN, INVALID_SPEC
from rinse.plans.audit import problems

# Limits of a specification.
MAX_DATE_FORMATS = 10
MAX_FORMAT_LENGTH = 40
MAX_RULES = 10
MAX_REPLACEMENT_LENGTH = 200

# What a date format may be made of. Weekday names can be written, not read.
_READABLE = r"\A(?:[yMdaHhmsS]|'[^']*'|[ ,./:-])++\z"
_WRITABLE = r"\A(?:[yMdEaHhmsS]|'[^']*'|[ ,./:-])++\z"


def _format_fits(one: Column, allowed: str) -> Column:
    return (F.length(one) <= MAX_FORMAT_LENGTH) & one.rlike(allowed)


def date_problem(input_formats: Column, output_format: Column) -> Column:
    """``struct<code, message>``, or null if the date specification may be used."""
    weekday = F.exists(
        input_formats, lambda one: F.regexp_replace(one, "'[^']*'", "").contains("E")
    )
    unreadable = F.exists(input_formats, lambda one: ~_format_fits(one, _READABLE))
    unwritable = ~_format_fits(output_format, _WRITABLE)
    message = (
        F.when(F.size(input_formats) == 0, "There are no input formats.")
        .when(F.size(input_formats) > MAX_DATE_FORMATS, "There are too many input formats.")
        .when(weekday, "Weekday names (E) cannot be read.")
        .when(unreadable, "An input format has parts that are not supported.")
        .when(unwritable, "The output format has parts that are not supported.")
    )
    return _with_code(message, INVALID_SPEC)


def group_count(pattern: Column) -> Column:
    """How many groups of the pattern capture: bare parentheses outside escapes and sets."""
    bare = F.regexp_replace(pattern, r"(?s)\\.", "")
    bare = F.regexp_replace(bare, r"\[\^?\]?[^\]]*\]", "")
    return F.regexp_count(bare, F.lit(r"\((?!\?)"))


def replacement_problem(pattern: Column, replacement: Column) -> Column:
    """``struct<code, message>``, or null if the replacement is text and ``$n`` references."""
    references = F.regexp_extract_all(replacement, F.lit(r"\$(\d)"), F.lit(1))
    highest = F.array_max(F.transform(references, lambda one: one.cast("int")))
    message = (
        F.when(F.length(replacement) > MAX_REPLACEMENT_LENGTH, "The replacement is too long.")
        .when(replacement.contains("\\"), "The replacement has a backslash.")
        .when(replacement.rlike(r"\$(?!\d)"), "A $ is not followed by a group number.")
        .when(highest > group_count(pattern), "The replacement refers to a missing group.")
        .when(replacement.rlike(r"\$\d\d"), "A group number is followed by a digit.")
    )
    return _with_code(message, INVALID_SPEC)


def rules_problem(rules: Column) -> Column:
    """``struct<code, message>``: the first problem of ``array<struct<pattern,replacement>>``."""
    size = F.size(rules)
    of_size = _with_code(
        F.when(size == 0, "There are no rules.").when(size > MAX_RULES, "There are too many rules."),
        INVALID_SPEC,
    )
    pairs = F.arrays_zip(rules.alias("rule"), _pattern_problems(rules["pattern"]).alias("found"))
    of_rules = F.transform(
        pairs,
        lambda pair: F.coalesce(
            _with_code(pair["found"], INVALID_PATTERN),
            replacement_problem(pair["rule"]["pattern"], pair["rule"]["replacement"]),
        ),
    )
    return F.coalesce(of_size, F.get(F.filter(of_rules, lambda one: one.isNotNull()), F.lit(0)))


@F.arrow_udf(ArrayType(StringType()))
def _pattern_problems(lists: pa.Array) -> pa.Array:
    found = problems(lists.flatten())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(lists), 0))
    offsets = pa.concat_arrays([pa.array([0], pa.int32()), ends.cast(pa.int32())])
    return pa.ListArray.from_arrays(offsets, found, mask=lists.is_null())


def _with_code(message: Column, code: str) -> Column:
    return F.when(
        message.isNotNull(), F.struct(F.lit(code).alias("code"), message.alias("message"))
    )
