"""Suggestions, stored as JSON, turned into specifications.

Each reader takes a table with one suggestion per row and adds a ``status``:
``ok``, ``malformed`` (not of the expected form), ``infeasible`` (the suggestion says so) or
``invalid`` (of the right form, but it must not be run), and a ``code`` and ``message`` for
the last two. All of it is row-local; only the pattern audit leaves the JVM.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rinse.errors import INVALID_SPEC, RinseError
from rinse.operators.cells import named
from rinse.operators.mask import KINDS
from rinse.plans.audit import verdict
from rinse.plans.specs import Dates, Rules
from rinse.plans.validation import MAX_DATE_FORMATS, MAX_RULES, date_problem, rules_problem

# The forms of the stored JSON.
NORMALIZATION = (
    "feasible boolean, kind string, input_formats array<string>, output_format string, "
    "rules array<struct<pattern:string,replacement:string>>, explanation string"
)
CLASSIFICATION = "columns array<struct<column:string,pii_types:array<string>>>, explanation string"
PATTERN = (
    "feasible boolean, pattern string, case_insensitive boolean, multiline boolean, "
    "dotall boolean, explanation string"
)

NO_KIND = "none"


def _any(*tests: Column) -> Column:
    return F.coalesce(reduce(Column.__or__, tests), F.lit(True))


def _some_null(array: Column) -> Column:
    return F.exists(array, lambda one: one.isNull())


def _json(df: DataFrame, column: str, schema: str) -> DataFrame:
    return df.withColumn("__s", F.from_json(named(column), schema))


def read_normalizations(df: DataFrame, column: str = "suggestion") -> DataFrame:
    """Add status, code, message, kind, input_formats, output_format and rules."""
    s = F.col("__s")
    malformed = _any(
        *(s[name].isNull() for name in ("feasible", "input_formats", "output_format")),
        *(s[name].isNull() for name in ("rules", "explanation")),
        ~F.coalesce(s["kind"].isin("date", "rules"), F.lit(False)),
        _some_null(s["input_formats"]),
        F.exists(s["rules"], lambda r: r["pattern"].isNull() | r["replacement"].isNull()),
        F.size(s["input_formats"]) > MAX_DATE_FORMATS,
        F.size(s["rules"]) > MAX_RULES,
    )
    dates = s["kind"] == "date"
    # A format listed twice needs trying once; the first place counts.
    formats = F.array_distinct(s["input_formats"])
    checked = _json(df, column, NORMALIZATION).withColumn(
        "__bad", F.when(dates, date_problem(formats, s["output_format"])).otherwise(
            rules_problem(F.when(~dates, s["rules"]))
        )
    )
    checked = checked.withColumn("__status", _status(malformed, s["feasible"]))
    usable = F.col("__status") == "ok"
    return checked.select(
        *map(named, df.columns),
        F.col("__status").alias("status"),
        *_explained(s["explanation"]),
        F.when(usable, s["kind"]).alias("kind"),
        F.when(usable & dates, formats).alias("input_formats"),
        F.when(usable & dates, s["output_format"]).alias("output_format"),
        F.when(usable & ~dates, s["rules"]).alias("rules"),
    )


def _status(malformed: Column, feasible: Column) -> Column:
    return (
        F.when(malformed, "malformed")
        .when(~feasible, "infeasible")
        .when(F.col("__bad").isNotNull(), "invalid")
        .otherwise("ok")
    )


def _explained(explanation: Column) -> list[Column]:
    invalid = F.col("__status") == "invalid"
    message = F.when(F.col("__status") == "infeasible", explanation)
    message = message.when(invalid, F.col("__bad.message"))
    return [F.when(invalid, F.col("__bad.code")).alias("code"), message.alias("message")]


def read_patterns(df: DataFrame, column: str = "suggestion") -> DataFrame:
    """Add status, code, message and pattern, the latter with its flags in front."""
    s = F.col("__s")
    fields = ("feasible", "pattern", "case_insensitive", "multiline", "dotall", "explanation")
    letters = F.concat(
        F.when(s["case_insensitive"], "i").otherwise(""),
        F.when(s["multiline"], "m").otherwise(""),
        F.when(s["dotall"], "s").otherwise(""),
    )
    flags = F.when(letters != "", F.concat(F.lit("(?"), letters, F.lit(")"))).otherwise("")
    parsed = _json(df, column, PATTERN)
    parsed = parsed.withColumn("__pattern", F.concat(flags, s["pattern"]))
    parsed = parsed.withColumn("__audit", verdict(F.col("__pattern")))
    bad = F.when(~F.col("__audit.ok"), F.struct("__audit.code", "__audit.message"))
    status = _status(_any(*(s[name].isNull() for name in fields)), s["feasible"])
    judged = parsed.withColumn("__bad", bad).withColumn("__status", status)
    return judged.select(
        *map(named, df.columns),
        F.col("__status").alias("status"),
        *_explained(s["explanation"]),
        F.when(F.col("__status") == "ok", F.col("__pattern")).alias("pattern"),
    )


def read_classifications(df: DataFrame, allowed: Column, column: str = "suggestion") -> DataFrame:
    """Add status and spec, ``array<struct<column, kinds>>`` of the allowed columns.

    Columns that were made up or hold nothing are left out, and a column listed twice has the
    kinds of both entries. The whole merge happens inside the row.
    """
    known = F.array(*map(F.lit, (*KINDS, NO_KIND)))
    s = F.col("__s")
    entries = s["columns"]

    def strange(entry: Column) -> Column:
        kinds = entry["pii_types"]
        return _any(
            entry["column"].isNull(),
            F.size(kinds) > len(KINDS) + 1,
            F.exists(kinds, lambda kind: ~F.array_contains(known, F.coalesce(kind, F.lit("")))),
        )

    malformed = _any(s["explanation"].isNull(), F.exists(entries, strange))
    listed = F.array_intersect(F.transform(entries, lambda e: e["column"]), allowed)
    spec = F.transform(
        listed,
        lambda name: F.struct(
            name.alias("column"),
            F.array_sort(
                F.array_except(
                    F.flatten(
                        F.transform(
                            F.filter(entries, lambda e: e["column"] == name),
                            lambda e: e["pii_types"],
                        )
                    ),
                    F.array(F.lit(NO_KIND)),
                )
            ).alias("kinds"),
        ),
    )
    return _json(df, column, CLASSIFICATION).select(
        *map(named, df.columns),
        F.when(malformed, "malformed").otherwise("ok").alias("status"),
        F.when(~malformed, F.filter(spec, lambda one: F.size(one["kinds"]) > 0)).alias("spec"),
    )


# --- one suggestion, for a job about to start -------------------------------------------


def _one(spark: SparkSession, suggestion: str) -> DataFrame:
    return spark.createDataFrame([(suggestion,)], "suggestion string")


def _usable(row) -> None:
    if row["status"] != "ok":
        asked = row.asDict()
        message = asked.get("message") or f"The suggestion is {row['status']}"
        raise RinseError(asked.get("code") or INVALID_SPEC, message)


def normalization(spark: SparkSession, suggestion: str) -> Dates | Rules:
    row = read_normalizations(_one(spark, suggestion)).first()
    _usable(row)
    if row["kind"] == "date":
        return Dates(tuple(row["input_formats"]), row["output_format"])
    return Rules(tuple((rule["pattern"], rule["replacement"]) for rule in row["rules"]))


def classification(
    spark: SparkSession, suggestion: str, columns: Sequence[str]
) -> dict[str, list[str]]:
    allowed = F.array(*map(F.lit, columns)).cast("array<string>")
    row = read_classifications(_one(spark, suggestion), allowed).first()
    _usable(row)
    return {entry["column"]: entry["kinds"] for entry in row["spec"]}


def suggested_pattern(spark: SparkSession, suggestion: str) -> str:
    row = read_patterns(_one(spark, suggestion)).first()
    _usable(row)
    return row["pattern"]
