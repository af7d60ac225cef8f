import json
import random
import re

import pytest
from pyspark.sql import functions as F

from rinse import Dates, RinseError, Rules
from rinse.functions.text import fingerprint, samples_text, squeeze
from rinse.plans.audit import audit_patterns, check_pattern, problem
from rinse.plans.reuse import answer_known, still_unknown
from rinse.plans.suggestions import classification, normalization, suggested_pattern
from rinse.plans.validation import (
    MAX_DATE_FORMATS,
    MAX_FORMAT_LENGTH,
    MAX_REPLACEMENT_LENGTH,
    MAX_RULES,
    date_problem,
    replacement_problem,
    rules_problem,
)
from tests.conftest import values

# one for each construct that repeats, nests or looks like something else
ACCEPTED = [
    "plain words",
    r"[A-Z]{3}-\d{4}/[a-z]",
    r"(?i)invoice\s+no\.?\s*\d+",
    r"(?:left|right) hand",
    r"(?:xy?z)+!",
    r"(?:[a-f]\d)+",
    r"(?:\d+;)*end",
    r"(?:q+)++r",
    r"(?>q+)r",
    r"(?<=№ )[0-9]+",
    r"(?!draft)\w+",
    r"\[(\d+)\]",
    r"[(+*]+x",
    r"\(\+\)\*",
    r"(\w)\1",
]
REJECTED = {
    "": "empty",
    "m" * 501: "more than 500",
    "[a-": "compile",
    "w)": "compile",
    r"(?<word>\d)w": "form",
    r"(w)?(?(1)x|y)": "form",
    "w(?#why)x": "form",
    "([p-r]+)*t": "backtracking",
    r"(?:\s*;\s*)+w": "backtracking",
    r"(?:\w|\d)+;": "backtracking",
    "(?:p|pp|q)*t": "backtracking",
    "(?:p{1,4}){20}t": "backtracking",
    "(?!(p+)+q)t": "backtracking",
    "(?:p?q?)*t": "backtracking",
    r"\s*": "empty text",
    "$": "empty text",
    "(?!w)": "empty text",
}


@pytest.mark.parametrize("pattern", ACCEPTED)
def test_accepted_patterns(pattern):
    assert problem(pattern) is None
    assert check_pattern(pattern) == pattern


@pytest.mark.parametrize("pattern", REJECTED)
def test_rejected_patterns(pattern):
    assert REJECTED[pattern] in problem(pattern)
    with pytest.raises(RinseError) as caught:
        check_pattern(pattern)
    assert caught.value.code == "INVALID_PATTERN"


def test_audit_of_a_table(spark):
    patterns = [*ACCEPTED, *REJECTED, None]
    df = spark.createDataFrame(list(enumerate(patterns)), "id long, pattern string")
    found = audit_patterns(df.repartition(3)).orderBy("id").collect()
    assert [row["ok"] for row in found] == [one in ACCEPTED for one in patterns]
    assert {row["code"] for row in found} == {None, "INVALID_PATTERN"}
    assert all((row["message"] is None) == row["ok"] for row in found)


def ways(body: str, text: str) -> int:
    """In how many ways the text splits into matches of the body."""
    counts = [1] + [0] * len(text)
    for end in range(1, len(text) + 1):
        counts[end] = sum(
            counts[start] for start in range(end) if re.fullmatch(body, text[start:end])
        )
    return counts[-1]


def test_ambiguity_against_brute_force():
    """A repeated body that splits some short text in two ways must be found out."""
    draw = random.Random(11)
    texts = ["".join(draw.choice("ab") for _ in range(length)) for length in range(1, 9) for _ in range(12)]
    seen = {True: 0, False: 0}
    for _ in range(400):
        atoms = [draw.choice(["a", "b", "[ab]", "a?", "b+", "(?:ab|b)", "(?:a|ba)"]) for _ in range(draw.randint(1, 3))]
        body = "".join(atoms)
        if re.fullmatch(body, "") or "b+" in body and "(?:" in body:
            continue
        ambiguous = any(ways(body, text) > 1 for text in texts)
        verdict = problem(f"(?:{body})+c") is not None
        if ambiguous:
            assert verdict, body
        seen[verdict] += 1
    assert min(seen.values()) > 20


# --- checks -----------------------------------------------------------------------------


LETTERS, OTHERS = "yMdaHhmsS", "BcGiKkLnpQqrTuVvwWxXzZ;_#()[]{}"


def test_date_specifications(spark):
    """Every letter alone, every length and every number around the limits."""
    cases = [([letter * 2], letter, True) for letter in LETTERS]
    cases += [([f"yy{other}"], "MM", False) for other in OTHERS]
    cases += [(["MM"], f"yy{other}", False) for other in OTHERS]
    cases += [([f"yy '{OTHERS}'"], f"'{OTHERS}' MM", True)]
    cases += [(["E dd"], "MM", False), (["dd 'E'"], "E dd", True), (["'open"], "MM", False), (["yy\tMM"], "MM", False), (["MM"], "", False)]
    cases += [(["y"] * many, "MM", 1 <= many <= MAX_DATE_FORMATS) for many in range(MAX_DATE_FORMATS + 3)]
    for size in (MAX_FORMAT_LENGTH - 1, MAX_FORMAT_LENGTH, MAX_FORMAT_LENGTH + 1):
        cases += [(["M" * size], "y", size <= MAX_FORMAT_LENGTH), (["y"], "M" * size, size <= MAX_FORMAT_LENGTH)]
    rows = [(at, formats, output) for at, (formats, output, _) in enumerate(cases)]
    df = spark.createDataFrame(rows, "at int, a array<string>, b string")
    found = dict(values(df.select("at", date_problem(F.col("a"), F.col("b"))["code"])))
    assert found == {at: None if fine else "INVALID_SPEC" for at, (_, _, fine) in enumerate(cases)}


def test_replacements(spark):
    """References up to the number of groups, wherever parentheses only look like groups."""
    cases = []
    for groups in range(4):
        pattern = r"\(" + "(?:u)" * 2 + "([vw])" * groups + "[(]" + "(?=z)"
        cases += [(pattern, f"<${number}>", number <= groups) for number in range(10)]
        cases += [(pattern, f"${number}{number}", False) for number in range(3)]
    cases += [("u", "text" + end, not end or end == " $0") for end in ("", " $", "\\", " $x", "\\$0", " $0")]
    cases += [("u", "t" * size, size <= MAX_REPLACEMENT_LENGTH) for size in (0, 1, MAX_REPLACEMENT_LENGTH, MAX_REPLACEMENT_LENGTH + 1)]
    df = spark.createDataFrame([(at, pattern, text) for at, (pattern, text, _) in enumerate(cases)], "at int, a string, b string")
    found = dict(values(df.select("at", replacement_problem(F.col("a"), F.col("b"))["code"])))
    assert found == {at: None if fine else "INVALID_SPEC" for at, (_, _, fine) in enumerate(cases)}


@pytest.mark.parametrize(
    ("rules", "code"),
    [
        ([("(k)l", "<$1>")], None),
        ([], "INVALID_SPEC"),
        ([("k", "l")] * MAX_RULES, None),
        ([("k", "l")] * (MAX_RULES + 1), "INVALID_SPEC"),
        ([("k", "l"), ("([kl]+){2,}m", "")], "INVALID_PATTERN"),
        ([("k", "$1"), ("([kl]+){2,}m", "")], "INVALID_SPEC"),
    ],
)
def test_rule_specifications(spark, rules, code):
    df = spark.createDataFrame([(rules,)], "r array<struct<pattern:string,replacement:string>>")
    found = df.select(rules_problem(F.col("r"))).first()[0]
    assert (found and found["code"]) == code


# --- suggestions ------------------------------------------------------------------------


def dates(**changes) -> str:
    whole = {
        "feasible": True, "kind": "date", "input_formats": ["yyyy-MM-dd", "dd/MM/yyyy"],
        "output_format": "yyyy-MM-dd", "rules": [], "explanation": "Writes dates.",
    }
    return json.dumps({**whole, **changes})


def test_normalizations(spark):
    assert normalization(spark, dates()) == Dates(("yyyy-MM-dd", "dd/MM/yyyy"), "yyyy-MM-dd")
    twice = dates(input_formats=["d", "y", "d"])
    assert normalization(spark, twice) == Dates(("d", "y"), "yyyy-MM-dd")
    rule = {"pattern": r"^(\d{3})$", "replacement": "$1"}
    rules = dates(kind="rules", input_formats=[], output_format="", rules=[rule])
    assert normalization(spark, rules) == Rules(((r"^(\d{3})$", "$1"),))


@pytest.mark.parametrize(
    ("suggestion", "message"),
    [
        (dates(feasible=False, explanation="Needs exchange rates."), "exchange rates"),
        ('{"kind": "date"}', "malformed"),
        ("not JSON", "malformed"),
        (dates(kind="other"), "malformed"),
        (dates(input_formats=["d"] * 11), "malformed"),
        (dates(rules=[{"pattern": "a"}]), "malformed"),
        (dates(input_formats=["QQ yyyy"]), "not supported"),
        (dates(kind="rules"), "no rules"),
    ],
)
def test_normalizations_that_cannot_be_used(spark, suggestion, message):
    with pytest.raises(RinseError, match=message):
        normalization(spark, suggestion)


def kinds(columns: dict) -> str:
    listed = [{"column": name, "pii_types": found} for name, found in columns.items()]
    return json.dumps({"columns": listed, "explanation": "e"})


def test_classifications(spark):
    whole = kinds(
        {"ID": ["none"], "Email": ["email"], "Notes": ["phone", "email", "none"], "Made up": ["email"]}
    )
    found = classification(spark, whole, ["ID", "Email", "Notes"])
    assert found == {"Email": ["email"], "Notes": ["email", "phone"]}
    assert classification(spark, whole, ["Email"]) == {"Email": ["email"]}
    assert classification(spark, kinds({}), ["Email"]) == {}
    twice = json.loads(kinds({"a": ["email"]}))
    twice["columns"].append({"column": "a", "pii_types": ["phone"]})
    assert classification(spark, json.dumps(twice), ["a"]) == {"a": ["email", "phone"]}
    for bad in (kinds({"a": ["shoe size"]}), '{"columns": []}', '{"columns": [{}], "explanation": ""}'):
        with pytest.raises(RinseError, match="malformed"):
            classification(spark, bad, ["a"])


def test_patterns(spark):
    whole = {
        "feasible": True, "pattern": r"\bvip\b", "case_insensitive": True, "multiline": False,
        "dotall": False, "explanation": "e",
    }
    assert suggested_pattern(spark, json.dumps(whole)) == r"(?i)\bvip\b"
    with pytest.raises(RinseError, match="backtracking"):
        suggested_pattern(spark, json.dumps({**whole, "pattern": "([kl]+)*m"}))
    with pytest.raises(RinseError, match="sentiment"):
        suggested_pattern(spark, json.dumps({**whole, "feasible": False, "explanation": "sentiment"}))


# --- fingerprints -----------------------------------------------------------------------


def test_fingerprints(spark):
    texts = ["find email addresses", "  find   email\taddresses\x1f ", "find EMAIL addresses"]
    df = spark.createDataFrame([(text,) for text in texts], "v string")

    def keys(namespace, *parts):
        key = fingerprint(namespace, *map(F.lit, parts), squeeze(F.col("v")))
        return [row[0] for row in df.select(key).collect()]

    base = keys("replace", "v1", "model")
    assert base[0] == base[1] != base[2]
    assert len({keys("replace", "v2", "model")[0], keys("other", "v1", "model")[0], base[0]}) == 3
    assert re.fullmatch("replace:[0-9a-f]{64}", base[0])


def test_samples_have_one_text(spark):
    df = spark.sql(
        "SELECT array(named_struct('column','b','values',array('2','1')),"
        " named_struct('column','a','values',array('x'))) AS s"
    )
    shown = json.loads(df.select(samples_text(F.col("s"))).first()[0])
    assert shown == [{"column": "a", "values": ["x"]}, {"column": "b", "values": ["2", "1"]}]


@pytest.mark.parametrize("limit", [0, 10**6])
def test_reuse(spark, limit):
    requests = spark.createDataFrame([(n, "hot" if n % 3 else f"k{n}") for n in range(30)], "n long, fingerprint string")
    known = spark.createDataFrame([("hot", "A"), ("k3", "B"), ("zz", "C")], "fingerprint string, spec string")
    found = answer_known(requests, known, limit).orderBy("n").collect()
    assert [row["n"] for row in found] == list(range(30))
    assert all(row["cached"] == (row["n"] % 3 != 0 or row["n"] == 3) for row in found)
    assert all((row["spec"] is not None) == row["cached"] for row in found)
    left = dict(values(still_unknown(requests, known)))
    assert left == {f"k{n}": 1 for n in range(0, 30, 3) if n != 3}
