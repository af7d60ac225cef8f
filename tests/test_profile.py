import random

import pytest
from pyspark.sql import functions as F

from rinse import (
    RinseError,
    classify_columns,
    infer_date_formats,
    kinds_by_column,
    mask,
    pattern_counts,
    pattern_examples,
    profile_kinds,
)
from rinse.functions.patterns import NAMED_PATTERNS
from rinse.operators.profile import date_masks
from tests.conftest import values

PEOPLE = [
    ("1", "John Doe", "VIP customer", "active", "P1234567", "12 Main Street"),
    ("2", "Jane Smith", "Call 816.227.4257", "closed", "123-45-6789", "7 Old Mill Road"),
    ("3", "Zoë Müller", "Contact backup at jane@example.com", "active", "DE44 5001 0517 5407 3249", None),
    ("4", None, "card 4111 1111 1111 1234", None, "none", "1 Long Ave"),
]
NAMES = ["ID", "Customer", "Notes", "Status", "Document", "Street"]


def test_profile_and_classification(table):
    df = table(NAMES, *PEOPLE)
    profile = {(row["column"], row["kind"]): row for row in profile_kinds(df, NAMES).collect()}
    assert len(profile) == 36
    assert profile["Notes", "phone"]["hits"] == 1, "the card is not a phone"
    assert profile["Customer", "person_name"]["rate"] == 1.0
    assert profile["Customer", "person_name"]["non_null"] == 3
    found = kinds_by_column(classify_columns(df, NAMES))
    assert found == {
        "Customer": ["person_name"],
        "Notes": ["credit_card", "email", "phone"],
        # The digits of the bank account number look like a card, to the mask as well.
        "Document": ["credit_card", "identifier"],
        "Street": ["address"],
    }
    rows = dict(values(classify_columns(df, ["Status", "ID"])))
    assert rows == {"ID": ["none"], "Status": ["none"]}
    masked = values(mask(df, kinds_by_column(classify_columns(df, ["Notes"]), {"ID": ["other"]})))
    assert masked[1][0] == "[REDACTED]" and masked[1][2] == "Call ***-***-4257"


def test_rare_kinds_stay_below_the_threshold(spark):
    df = spark.range(1000).select(F.when(F.col("id") == 5, "a@b.org").otherwise("x").alias("v"))
    assert kinds_by_column(classify_columns(df, ["v"])) == {}
    assert kinds_by_column(classify_columns(df, ["v"], in_text_rate=0.001)) == {"v": ["email"]}


def test_a_profile_is_one_scan_with_partial_sums(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    plan = profile_kinds(documents, ["text"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Exchange") == 1
    assert "ReadSchema: struct<text:string>" in plan and "partial_count" in plan


def test_empty_table(table):
    df = table(["v"])
    assert {row["rate"] for row in profile_kinds(df, ["v"]).collect()} == {0.0}
    [found] = infer_date_formats(df, "v", ["yyyy"]).collect()
    assert (found["input_formats"], found["values"], found["coverage"]) == ([], 0, 0.0)


def test_date_formats(table):
    texts = ["2020-04-24", "25/10/2018", "26/10/2018", "03/04/2020", "Nov 22, 2021", "soon", None]
    df = table(["d"], *((text,) for text in texts))
    candidates = ["MM/dd/yyyy", "dd/MM/yyyy", "yyyy-MM-dd", "MMM d, yyyy", "yyyyMMdd"]
    assert sorted(values(date_masks(df, "d", candidates))) == [(0, 1), (2, 2), (3, 1), (4, 1), (8, 1)]
    [found] = infer_date_formats(df, "d", candidates).collect()
    assert found["input_formats"] == ["dd/MM/yyyy", "yyyy-MM-dd", "MMM d, yyyy"]
    assert (found["values"], found["recognised"], found["ambiguous"]) == (6, 5, 1)
    assert found["coverage"] == 5 / 6
    tie = table(["d"], ("03/04/2020",))
    [found] = infer_date_formats(tie, "d", candidates).collect()
    assert found["input_formats"] == ["MM/dd/yyyy"]
    for wrong in ([], ["yyyy"] * 11):
        with pytest.raises(RinseError):
            date_masks(df, "d", wrong)


def test_pattern_report(spark):
    df = spark.createDataFrame(
        [(3, "a@x.org b@x.org", None), (1, "c@x.org", "2020-01-01"), (2, "none", "x")],
        "key long, first string, second string",
    )
    patterns = {name: NAMED_PATTERNS[name] for name in ("email", "iso_date")}
    counts = sorted(values(pattern_counts(df, ["first", "second"], patterns)))
    assert counts == [
        ("first", "email", 2, 3), ("first", "iso_date", 0, 0),
        ("second", "email", 0, 0), ("second", "iso_date", 1, 1),
    ]
    examples = sorted(values(pattern_examples(df, ["first", "second"], patterns, "key", 2)))
    assert examples == [
        ("first", "email", 1, "c@x.org"), ("first", "email", 2, "a@x.org"),
        ("second", "iso_date", 1, "2020-01-01"),
    ]


def test_examples_are_cut_in_the_tasks(spark):
    documents = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    found = pattern_examples(documents, ["text"], {"email": NAMED_PATTERNS["email"]}, "doc_id")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_the_shortest_list_of_formats(spark):
    """Every table of values against an enumeration of all lists."""
    candidates = ["ddMMyyyy", "yyyyMMdd", "MMddyyyy", "yyyy-MM-dd"]
    values_by_mask = {0b0011: "20101112", 0b0101: "01022013", 0b0010: "19991010", 0b0100: "12282013", 0b1000: "2020-02-03", 0: "none"}
    assert {row["mask"] for row in date_masks(spark.createDataFrame([(v,) for v in values_by_mask.values()], "d string"), "d", candidates).collect()} == set(values_by_mask)
    rng = random.Random(2)
    for _ in range(8):
        counts = {mask: rng.randint(1, 5) for mask in rng.sample(sorted(values_by_mask), rng.randint(1, 6))}
        rows = [(values_by_mask[mask],) for mask, many in counts.items() for _ in range(many)]
        [found] = infer_date_formats(spark.createDataFrame(rows, "d string"), "d", candidates).collect()
        covers = [s for s in range(16) if all(mask & s for mask in counts if mask)]
        fewest = min(bin(s).count("1") for s in covers)
        taken = sum(1 << candidates.index(name) for name in found["input_formats"])
        assert taken in covers and len(found["input_formats"]) == fewest
        assert found["recognised"] == sum(many for mask, many in counts.items() if mask)

