"""What the columns hold: kinds of personal data, date formats, matches of patterns.

Each profile is one aggregate over whole columns with partial sums in every task. Results have
a few rows per column, whatever the size of the table.
"""

from __future__ import annotations

from collections.abc import Callable, Collection, Iterable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rinse.errors import INVALID_SPEC, RinseError
from rinse.functions import masks
from rinse.functions.dates import read_date
from rinse.operators.cells import named, present
from rinse.operators.find_replace import check_java_pattern, found, may_match
from rinse.operators.mask import IN_TEXT, KINDS

# --- personal data ----------------------------------------------------------------------

# Names, identifiers and addresses are values of their own, or stand at their beginning.
_PERSON = r"^\p{Lu}[\p{L}'’-]+(?: \p{Lu}[\p{L}'’.-]*){1,3}$"
_IDENTIFIER = r"^(?:[A-Z]{1,2}\d{6,9}|\d{3}-\d{2}-\d{4}|[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7})$"
_STREET = (
    r"^\d{1,5} (?:\p{Lu}[\p{L}'.-]* ){1,4}"
    r"(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Way|Court|Ct|Square|Sq)\b"
)


def _whole(pattern: str) -> Callable[[Column], Column]:
    return lambda value: value.rlike(pattern)


def _phone_beside_cards(value: Column) -> Column:
    """A phone number that is not part of a card number."""
    without = masks.has_phone(masks.mask_card(value))
    return F.when(masks.has_card(value), without).otherwise(masks.has_phone(value))


# ``other`` has no form to look for; a user adds it by hand.
DETECTORS: dict[str, Callable[[Column], Column]] = {
    "email": masks.has_email,
    "phone": _phone_beside_cards,
    "person_name": _whole(_PERSON),
    "credit_card": masks.has_card,
    "identifier": _whole(_IDENTIFIER),
    "address": _whole(_STREET),
}

# The share of values from which a kind counts as present.
IN_TEXT_RATE = 0.01
WHOLE_VALUE_RATE = 0.5


def profile_kinds(df: DataFrame, columns: Iterable[str]) -> DataFrame:
    """``(column, kind, non_null, hits, rate)`` for every column and detectable kind."""
    names = present(df, columns)
    sums, rows = [], []
    for at, name in enumerate(names):
        value = named(name).cast("string")
        sums.append(F.count(value).alias(f"n{at}"))
        for kind, detector in DETECTORS.items():
            sums.append(F.count_if(detector(value)).alias(f"n{at}_{kind}"))
            non_null, hits = F.col(f"n{at}"), F.col(f"n{at}_{kind}")
            rows.append(
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(kind).alias("kind"),
                    non_null.alias("non_null"),
                    hits.alias("hits"),
                    F.coalesce(F.try_divide(hits, non_null), F.lit(0.0)).alias("rate"),
                )
            )
    if not rows:
        raise RinseError(INVALID_SPEC, "No columns to profile")
    return df.agg(*sums).select(F.inline(F.array(*rows)))


def classify_columns(
    df: DataFrame,
    columns: Iterable[str],
    in_text_rate: float = IN_TEXT_RATE,
    whole_value_rate: float = WHOLE_VALUE_RATE,
) -> DataFrame:
    """``(column, pii_types)`` in the form of a classification: ``["none"]`` if clean."""
    profile = profile_kinds(df, columns)
    needed = F.when(F.col("kind").isin(*IN_TEXT), in_text_rate).otherwise(whole_value_rate)
    kinds = F.collect_list(F.when((F.col("hits") > 0) & (F.col("rate") >= needed), F.col("kind")))
    return profile.groupBy("column").agg(F.array_sort(kinds).alias("found")).select(
        "column",
        F.when(F.size("found") == 0, F.array(F.lit("none"))).otherwise(F.col("found")).alias(
            "pii_types"
        ),
    )


def kinds_by_column(
    classification: DataFrame, overrides: Mapping[str, Collection[str]] | None = None
) -> dict[str, list[str]]:
    """The classification as ``mask`` takes it: one small row per column of the table."""
    found = {row["column"]: row["pii_types"] for row in classification.collect()}
    found.update(overrides or {})
    return {
        name: [kind for kind in kinds if kind in KINDS]
        for name, kinds in found.items()
        if set(kinds) & set(KINDS)
    }


# --- date formats -----------------------------------------------------------------------

# Fixed value: as many candidates as a date specification may list.
MAX_FORMATS = 10


def date_masks(df: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """``(mask, values)``: bit *i* of the mask is set where the *i*-th format fits.

    At most 2**10 rows, counted in the tasks before anything moves.
    """
    if not 0 < len(formats) <= MAX_FORMATS:
        raise RinseError(INVALID_SPEC, f"Give 1 to {MAX_FORMATS} candidate formats")
    [name] = present(df, [column])
    tidy = F.trim(named(name).cast("string"))
    bits = [
        F.when(read_date(tidy, one).isNotNull(), 1 << at).otherwise(0)
        for at, one in enumerate(formats)
    ]
    mask = sum(bits[1:], bits[0])
    return (
        df.where(named(name).isNotNull())
        .groupBy(mask.cast("int").alias("mask"))
        .agg(F.count(F.lit(1)).alias("values"))
    )


def infer_date_formats(df: DataFrame, column: str, formats: Sequence[str]) -> DataFrame:
    """The shortest list of candidates that reads all recognisable values.

    One row: ``input_formats`` in the order to try them, ``values``, ``recognised``,
    ``ambiguous`` (several formats fit) and ``coverage``. All subsets of the candidates are
    looked at, 2**10 at most; of several shortest ones the one with the earlier candidates counts.
    The list begins with the format that reads most values, then that which reads most of the
    others, the earlier candidate on a tie.
    """
    masks_seen = date_masks(df, column, formats).agg(
        F.collect_list(F.struct("mask", "values")).alias("seen")
    )
    steps = f"sequence(0, {len(formats) - 1})"
    gain = """aggregate(seen, 0L, (total, one) -> total + if(
        (shiftright(one.mask, at) & 1) = 1 AND (one.mask & state.taken) = 0, one.values, 0L))"""
    # a subset reads everything if it has a format of each mask
    covers = f"""filter(sequence(0, {(1 << len(formats)) - 1}),
        chosen -> forall(seen, one -> one.mask = 0 OR (one.mask & chosen) <> 0))"""
    places = f"filter({steps}, at -> (shiftright(chosen, at) & 1) = 1)"
    smallest = f"""array_min(transform({covers},
        chosen -> named_struct('size', bit_count(chosen), 'places', {places}))).places"""
    best = "array_max(transform(picks, at -> named_struct('gain', " + gain + ", 'rank', -at)))"
    chosen = f"""aggregate(picks,
        named_struct('taken', 0, 'list', cast(array() AS array<int>)),
        (state, step) -> transform(array({best}), pick -> if(pick.gain = 0, state,
            named_struct('taken', state.taken | shiftleft(1, -pick.rank),
                         'list', array_append(state.list, -pick.rank))))[0]).list"""
    count = "aggregate(filter(seen, one -> {}), 0L, (total, one) -> total + one.values)"
    names = F.array(*map(F.lit, formats))
    return masks_seen.withColumn("picks", F.expr(smallest)).select(
        F.transform(F.expr(chosen), lambda at: F.get(names, at)).alias("input_formats"),
        F.expr(count.format("true")).alias("values"),
        F.expr(count.format("one.mask > 0")).alias("recognised"),
        F.expr(count.format("bit_count(one.mask) > 1")).alias("ambiguous"),
    ).withColumn(
        "coverage", F.coalesce(F.try_divide(F.col("recognised"), F.col("values")), F.lit(0.0))
    )


# --- patterns ---------------------------------------------------------------------------


def pattern_counts(
    df: DataFrame, columns: Iterable[str], patterns: Mapping[str, str]
) -> DataFrame:
    """``(column, pattern, rows_matched, matches)`` for every column and named pattern.

    The patterns are constants of the plan, so each task compiles each of them once.
    """
    names = present(df, columns)
    for one in patterns.values():
        check_java_pattern(df.sparkSession, one)
    found_times, sums, rows = [], [], []
    for at, name in enumerate(names):
        value = named(name).cast("string")
        for number, (label, one) in enumerate(patterns.items()):
            times, possible = F.regexp_count(value, F.lit(one)), may_match(value, one)
            if possible is not None:
                times = F.when(possible, times).otherwise(0)
            key = f"{at}_{number}"
            found_times.append(times.alias(f"t{key}"))
            sums.append(F.count_if(F.col(f"t{key}") > 0).alias(f"r{key}"))
            sums.append(F.sum(f"t{key}").alias(f"m{key}"))
            rows.append(
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(label).alias("pattern"),
                    F.col(f"r{key}").alias("rows_matched"),
                    F.coalesce(F.col(f"m{key}"), F.lit(0)).alias("matches"),
                )
            )
    if not rows:
        raise RinseError(INVALID_SPEC, "Give at least one column and one pattern")
    return df.select(*found_times).agg(*sums).select(F.inline(F.array(*rows)))


def pattern_examples(
    df: DataFrame, columns: Iterable[str], patterns: Mapping[str, str], key: str, count: int = 3
) -> DataFrame:
    """``(column, pattern, rank, example)``: the first match in the first matching rows by key.

    Only rows with a match leave the scan, and every task keeps ``count`` of them per group.
    """
    names = present(df, columns)
    candidates = []
    for name in names:
        value = named(name).cast("string")
        for label, one in patterns.items():
            first = F.when(found(value, one), F.regexp_extract(value, one, 0))
            candidates.append(
                F.struct(
                    F.lit(name).alias("column"),
                    F.lit(label).alias("pattern"),
                    named(key).alias("key"),
                    first.alias("example"),
                )
            )
    cells = df.select(F.inline(F.array(*candidates)))
    hits = cells.where(F.col("example").isNotNull())
    order = Window.partitionBy("column", "pattern").orderBy("key")
    ranked = hits.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= count).select("column", "pattern", "rank", "example")
