import itertools
import time

import pytest
from pyspark.sql import functions as F

from rinse import Dates, RinseError, Rules, reformat
from rinse.functions.dates import read_date, shape
from tests.conftest import values

FORMATS = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy")
PHONE = r"^(?:\+?1[\s.-]?)?\(?(\d{3})\)?[\s.-]?(\d{3})[\s.-]?(\d{4})$"


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("2020-04-24", ("2020-04-24", True)),
        ("25/10/2018", ("2018-10-25", True)),
        ("Nov 22, 2021", ("2021-11-22", True)),
        ("nov 22, 2021", ("2021-11-22", True)),
        (" Jan 2, 2024 ", ("2024-01-02", True)),
        ("\t2020-04-24", ("\t2020-04-24", False)),
        ("next tuesday", ("next tuesday", False)),
        (" next ", (" next ", False)),
        (None, (None, False)),
        ("", ("", False)),
        ("2020-13-45", ("2020-13-45", False)),
        ("2020-04-24T10:00", ("2020-04-24T10:00", False)),
    ],
)
def test_dates(table, text, wanted):
    out = reformat(table(["d"], (text,)), ["d"], Dates(FORMATS, "yyyy-MM-dd"))
    assert values(out) == [wanted]


def test_output_format_and_first_format_wins(table):
    df = table(["d"], ("2020-04-24",), ("03/04/2020",))
    out = reformat(df, ["d"], Dates(("yyyy-MM-dd", "MM/dd/yyyy", "dd/MM/yyyy"), "dd MMM yyyy"))
    assert values(out) == [("24 Apr 2020", True), ("04 Mar 2020", True)]


@pytest.mark.parametrize(
    "spec",
    [
        Dates(("yyyy-MM-dd",), "{bad}"),
        Dates(("EEE d",), "yyyy"),
        Dates(("YYYY-ww",), "yyyy"),
        Dates(("yyyy", "'open"), "yyyy"),
    ],
)
def test_formats_spark_refuses_fail_first(table, spec):
    with pytest.raises(RinseError) as caught:
        reformat(table(["d"], ("x",)), ["d"], spec)
    assert caught.value.code == "INVALID_SPEC"


def test_shape_lets_everything_through_that_parses(spark):
    """Over many formats and texts, the shape test never turns a readable date away."""
    formats = [
        "yyyy-MM-dd", "d/M/yy", "yyyyMMdd", "MMM d, yyyy", "d MMMM yyyy", "dd.MM.yyyy HH:mm:ss",
        "yyyy-MM-dd'T'HH:mm:ss.SSS", "'Week of' d MMM yyyy", "h:mm a, d MMM yyyy", "d''MM''yyyy",
        "y-M-d", "D yyyy", "yyyy-MM-dd hh:mm a",
    ]
    days = ["2020-04-24 13:05:09", "1999-12-01 00:00:00", "2024-02-29 23:59:59"]
    texts = [
        row[0]
        for one, day in itertools.product(formats, days)
        for row in spark.sql(
            "SELECT date_format(CAST(:d AS timestamp), :f)", args={"d": day, "f": one}
        ).collect()
    ]
    texts += [text.upper() for text in texts] + ["+12020-04-24", "-5-1-1", "x", "1/1/1", "2020-04-24\n"]
    df = spark.createDataFrame([(text,) for text in texts], "v string")
    for one in formats:
        plain, quick = F.try_to_date("v", one), read_date(F.col("v"), one)
        seen = df.agg(F.count(plain), F.count_if(~plain.eqNullSafe(quick))).first()
        assert seen[0] > 0 and seen[1] == 0, one
    assert shape("EEE d") is None and shape("yyyy[-MM]") is None
    assert shape("yyyy-MM-dd") is not None


@pytest.mark.parametrize(
    ("text", "wanted"),
    [
        ("+1 (892) 958-9935", ("892-958-9935", True)),
        ("816.227.4257", ("816-227-4257", True)),
        ("not a phone", ("not a phone", False)),
        (None, (None, False)),
    ],
)
def test_rules(table, text, wanted):
    out = reformat(table(["v"], (text,)), ["v"], Rules(((PHONE, "$1-$2-$3"),)))
    assert values(out) == [wanted]


def test_first_rule_that_matches_wins(table):
    spec = Rules(((r"^(\d+)$", "number $1"), (r"^(\w+)$", "word $1"), ("a", "never")))
    out = reformat(table(["v"], ("42",), ("abc",), ("a b a",)), ["v"], spec)
    assert values(out) == [("number 42", True), ("word abc", True), ("never b never", True)]


def test_rule_patterns_are_compiled_first(table):
    with pytest.raises(RinseError) as caught:
        reformat(table(["v"], ("x",)), ["v"], Rules((("ok", ""), ("(bad", ""))))
    assert caught.value.code == "INVALID_PATTERN"


def test_long_digits_are_turned_away_at_once(spark):
    cells = ["9" * 10_000 + "x", "1" * 10_000, "-" * 10_000, "a" * 10_000 + "!", "2024" * 2_500 + " AM"]
    table = spark.createDataFrame([(cell,) for cell in cells], "cell string")
    formats = ["yyyyMMddHHmmss", "yyyyMMdd", "yyyyMMddHHmmssSSS", "d MMM yyyy", "MMMM d yyyy h:mm a", "yyyy-MM-dd"]
    read = [read_date(F.col("cell"), one).alias(str(at)) for at, one in enumerate(formats)]
    started = time.perf_counter()
    assert not any(value for row in table.select(*read).collect() for value in row)
    assert time.perf_counter() - started < 10


def test_compact_dates_are_read(spark):
    table = spark.createDataFrame([("20240229", "20240229235959")], "day string, second string")
    row = table.select(read_date(F.col("day"), "yyyyMMdd"), read_date(F.col("second"), "yyyyMMddHHmmss")).first()
    assert [str(value) for value in row] == ["2024-02-29"] * 2
