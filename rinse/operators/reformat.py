"""Bringing the values of a column into one format."""

from __future__ import annotations

from collections.abc import Iterable, Sequence

from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import INVALID_SPEC, RinseError, first_line
from rinse.functions.dates import first_date
from rinse.operators.cells import Cell, Rule, clean_alike, present
from rinse.operators.find_replace import check_java_pattern, found
from rinse.plans.specs import Dates, Rules


def writing_dates(input_formats: Sequence[str], output_format: str) -> Rule:
    """Dates in any input format become the output format. Hit: a date was recognised."""

    def rule(value: Column) -> Cell:
        day = first_date(value, input_formats)
        return Cell(F.coalesce(F.date_format(day, output_format), value), day.isNotNull())

    return rule


def first_rule(rules: Sequence[tuple[str, str]]) -> Rule:
    """The first rule that matches rewrites all its matches; ``$n`` refers to its groups."""

    def rule(value: Column) -> Cell:
        chosen, text = F, F
        for number, (pattern, _) in enumerate(rules):
            chosen = chosen.when(found(value, pattern), F.lit(number))
        for number, (pattern, replacement) in enumerate(rules):
            text = text.when(chosen == number, F.regexp_replace(value, pattern, replacement))
        return Cell(text.otherwise(value), chosen.isNotNull())

    return rule


def reformat(df: DataFrame, columns: Iterable[str], spec: Dates | Rules) -> DataFrame:
    """Apply a date or rule specification, after Spark has accepted all its parts."""
    names = present(df, columns)
    spark = df.sparkSession
    if isinstance(spec, Dates):
        check_date_formats(spark, spec)
        return clean_alike(df, names, writing_dates(spec.input_formats, spec.output_format))
    for pattern, _ in spec.rules:
        check_java_pattern(spark, pattern)
    return clean_alike(df, names, first_rule(spec.rules))


def check_date_formats(spark: SparkSession, spec: Dates) -> None:
    """Fail now if Spark cannot read the input formats or write the output format."""
    day = F.lit("2000-01-02").cast("date")
    reads = [F.try_to_date(F.lit("x"), one) for one in spec.input_formats]
    try:
        one_row = spark.sql("SELECT 1")
        one_row.select(*reads, F.date_format(day, spec.output_format)).collect()
    except PySparkException as error:
        message = f"Spark cannot use the date formats: {first_line(error)}"
        raise RinseError(INVALID_SPEC, message) from error
