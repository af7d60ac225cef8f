import random
import re

import pytest
from pyspark.sql import functions as F

from rinse import MATCHED, ROW_ID, RinseError, clean, find_replace, replacing
from rinse.functions.patterns import pattern, with_flags, word
from rinse.functions.regex_tree import required_text
from rinse.functions.text import literal_replacement, literal_replacement_of
from rinse.operators.cells import present, user_columns
from rinse.operators.find_replace import check_java_pattern, found
from tests.conftest import values

EMAIL = r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,7}\b"


def test_targets_change_in_place_and_others_stay(table):
    df = table(["Email", "Other", "Notes"], ("a@x.com", "b@y.org", "note a@x.com"))
    out = find_replace(df, ["Email", "Other"], EMAIL, "REDACTED")
    assert out.columns == ["Email", "Other", "Notes", MATCHED]
    assert values(out) == [("REDACTED", "REDACTED", "note a@x.com", True)]


@pytest.mark.parametrize(
    ("text", "expression", "replacement", "wanted"),
    [
        ("Contact a@x.com today", EMAIL, "[email]", ("Contact [email] today", True)),
        ("no email here", EMAIL, "REDACTED", ("no email here", False)),
        (None, EMAIL, "REDACTED", (None, False)),
        ("", EMAIL, "REDACTED", ("", False)),
        ("price", "price", "$1 cost", ("$1 cost", True)),
        ("price", "price", "C:\\temp\\", ("C:\\temp\\", True)),
        ("price", "price", "$0\\$", ("$0\\$", True)),
        ("price tag", "price ", "", ("tag", True)),
        ("same", "same", "same", ("same", True)),
        ("Zoë Müller → zoe@example.com", EMAIL, "✉", ("Zoë Müller → ✉", True)),
        ("A a\nA", with_flags("^a$", ignore_case=True, multiline=True), "x", ("A a\nx", True)),
    ],
)
def test_vectors(table, text, expression, replacement, wanted):
    out = find_replace(table(["v"], (text,)), ["v"], expression, replacement)
    assert values(out) == [wanted]


def test_a_column_listed_twice_is_changed_once(table):
    assert values(find_replace(table(["v"], ("a",)), ["v", "v"], "a", "aa")) == [("aa", True)]


@pytest.mark.parametrize("name", ["Email Address", "contact.email", "back`tick"])
def test_odd_column_names(spark, name):
    df = spark.createDataFrame([("a@x.com",)], ["v"]).toDF(name)
    out = find_replace(df, [name], EMAIL, "x")
    assert out.columns == [name, MATCHED]
    assert values(out) == [("x", True)]


def test_columns_of_other_types_are_cast(spark):
    df = spark.sql("SELECT 1771 AS n, DATE'2020-07-07' AS d")
    assert values(find_replace(df, ["n", "d"], "7+", "-")) == [("1-1", "2020-0--0-", True)]


def test_no_targets(table):
    assert values(clean(table(["v"], ("1",)), {})) == [("1", False)]


def test_missing_columns_are_listed_in_order_without_a_job(table):
    df = table(["ID", "Email"], ("1", "x"))
    with pytest.raises(RinseError) as caught:
        find_replace(df, ["b", "Email", "a", "b", MATCHED], "x", "")
    assert caught.value.code == "COLUMN_NOT_FOUND"
    assert caught.value.names == ["b", "a", MATCHED]
    assert present(df, ["Email", "ID", "Email"]) == ["Email", "ID"]


def test_a_second_flag_column_is_refused(table):
    once = find_replace(table(["v"], ("a",)), ["v"], "a", "b")
    with pytest.raises(RinseError) as caught:
        find_replace(once, ["v"], "b", "c")
    assert caught.value.code == "RESERVED_COLUMN"
    assert user_columns(once.withColumn(ROW_ID, F.lit(1))).columns == ["v"]


@pytest.mark.parametrize("bad", ["(unclosed", "*a", "[a", r"\p{NoSuch}"])
def test_patterns_java_refuses(spark, bad):
    with pytest.raises(RinseError) as caught:
        check_java_pattern(spark, bad)
    assert caught.value.code == "INVALID_PATTERN"


def test_flags_and_names():
    assert with_flags("a", dotall=True, ignore_case=True) == "(?is)a"
    assert with_flags("a", multiline=True) == "(?m)a"
    assert with_flags("a") == "a"
    assert word("vip customer") == r"(?i)\bvip customer\b"
    assert re.search(pattern("iso_date"), "on 2024-02-29.") and not re.search(pattern("iso_date"), "2024-13-01")
    with pytest.raises(RinseError):
        pattern("nothing")
    with pytest.raises(RinseError):
        word("a+")


def test_replacements_as_columns(spark):
    texts = ["$1", "a\\b", "plain", "\\$"]
    df = spark.createDataFrame([(text,) for text in texts], "r string")
    assert [row[0] for row in df.select(literal_replacement_of(F.col("r"))).collect()] == [
        literal_replacement(text) for text in texts
    ]


@pytest.mark.parametrize(
    ("expression", "pieces"),
    [
        (EMAIL, ("@", ".")),
        ("abc", ("abc",)),
        (r"a\.b+c", ("a.", "b", "c")),
        ("a(bc)?d", ("a", "d")),
        ("ab|ac", ()),
        ("(ab)c", ("abc",)),
        ("x(?=y)z", ("xz",)),
        ("(?i)abc", ()),
        (r"\Qa|b\E", ()),
        ("[a&&[b]]c", ()),
        ("[]a]b", ()),
        (r"\p{L}x", ()),
        ("a{2}b", ("a", "b")),
        ("a{0,2}b", ("b",)),
        ("(a|b)+c", ("c",)),
        ("", ()),
    ],
)
def test_text_a_pattern_needs(expression, pieces):
    assert required_text(expression) == pieces


def test_looking_for_text_first_changes_nothing(spark):
    """Random patterns over random texts: the quick test and the plain one agree."""
    draw = random.Random(5)
    atoms = ["a", "b", "c", ".", r"\.", r"\d", "[ab]", "[^a]", r"\b", "(a|b)", "(?:bc)", "(ab)"]
    atoms += ["(?=a)", "(?!b)", "^", "$", "1", "-"]
    times = ["", "", "", "?", "*", "+", "{2}", "{0,1}", "+?"]
    texts = ["".join(draw.choice("abc.1- ") for _ in range(draw.randint(0, 12))) for _ in range(300)]
    df = spark.createDataFrame([(text,) for text in texts], "v string").coalesce(1).cache()
    checked = []
    for _ in range(120):
        parts = []
        for _ in range(draw.randint(1, 5)):
            atom = draw.choice(atoms)
            zero = atom in ("^", "$", r"\b") or atom.startswith("(?=") or atom.startswith("(?!")
            parts.append(atom + ("" if zero else draw.choice(times)))
        expression = "".join(parts) if draw.random() < 0.8 else "|".join(parts)
        checked.append((expression, F.col("v").rlike(expression), found(F.col("v"), expression)))
    assert sum(bool(required_text(expression)) for expression, _, _ in checked) > 20
    different = df.agg(*(F.count_if(plain != quick) for _, plain, quick in checked)).first()
    assert [checked[at][0] for at, count in enumerate(different) if count] == []


def test_rules_of_different_kinds_in_one_pass(table):
    df = table(["a", "b"], ("x1", "y2"), ("z", None))
    out = clean(df, {"b": replacing(r"\d", "#"), "a": replacing("x", "")})
    assert values(out) == [("1", "y#", True), ("z", None, False)]
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan
