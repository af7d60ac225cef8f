import random

import pytest
from pyspark.sql import functions as F

from rinse import RinseError, mask
from rinse.functions import masks
from tests.conftest import values


@pytest.mark.parametrize(
    ("kinds", "text", "wanted"),
    [
        (["email"], "john.doe@example.com", "j***@example.com"),
        (["email"], "Contact backup at a_b@mail.co.uk today", "Contact backup at a***@mail.co.uk today"),
        (["email"], "VIP customer", "VIP customer"),
        (["phone"], "+1 (892) 958-9935", "***-***-9935"),
        (["phone"], "Call 816.227.4257", "Call ***-***-4257"),
        (["phone"], "552-818-5333", "***-***-5333"),
        (["credit_card"], "4111 1111 1111 1234", "**** **** **** 1234"),
        (["credit_card"], "4111-1111-1111-1234", "**** **** **** 1234"),
        (["credit_card"], "4111111111111234", "**** **** **** 1234"),
        (["credit_card"], "378282246310005", "378282246310005"),
        (["phone", "credit_card"], "4111111111111234", "**** **** **** 1234"),
        (["person_name"], "John Doe", "J. D."),
        (["person_name"], "Zoë Müller", "Z. M."),
        (["person_name"], "J. D.", "J.. D.."),
        (["phone", "email"], "Call 816.227.4257 or mail jane@example.com",
         "Call ***-***-4257 or mail j***@example.com"),
        (["person_name", "email"], "Jane jane@example.com", "J. j.@e..c."),
        (["identifier"], "P1234567", "[REDACTED]"),
        (["address", "person_name", "email"], "1 Road", "[REDACTED]"),
        (["other"], "", "[REDACTED]"),
        (["other"], "[REDACTED]", "[REDACTED]"),
        (["other"], None, None),
        (["email"], None, None),
        ([], "a@b.com", "a@b.com"),
    ],
)
def test_vectors(table, kinds, text, wanted):
    out = mask(table(["v"], (text,)), {"v": kinds})
    assert values(out) == [(wanted, wanted != text)]


def test_columns_of_different_kinds(table):
    df = table(["ID", "Name", "Email"], ("1", "John Doe", "x"), ("2", None, "a@b.io"))
    out = mask(df, {"Email": ["email"], "Name": ["person_name"]})
    assert values(out) == [("1", "J. D.", "x", True), ("2", None, "a***@b.io", True)]
    assert values(mask(df.select("ID").limit(1), {})) == [("1", False)]


def test_unknown_kinds_and_columns(table):
    with pytest.raises(RinseError) as caught:
        mask(table(["v"], ("x",)), {"v": ["shoe size"]})
    assert caught.value.code == "INVALID_SPEC"
    with pytest.raises(RinseError) as caught:
        mask(table(["v"], ("x",)), {"w": ["email"]})
    assert caught.value.code == "COLUMN_NOT_FOUND"


def test_quick_tests_agree_with_the_whole_patterns(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text")
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html")
    draw = random.Random(2)
    numbers = [
        ("".join(draw.choice("0123456789" * 3 + " -.()+x@") for _ in range(draw.randint(8, 40))),)
        for _ in range(4000)
    ]
    texts = documents.union(pages).union(spark.createDataFrame(numbers, "text string"))
    v = F.col("text")
    plain = {
        "credit_card": (masks.CARD, "**** **** **** $1", masks.mask_card, masks.has_card),
        "phone": (masks.PHONE, "***-***-$1", masks.mask_phone, masks.has_phone),
        "email": (masks.EMAIL, "$1***$2", masks.mask_email, masks.has_email),
    }
    checks, hits = [], []
    for expression, replacement, quick, has in plain.values():
        checks.append(F.count_if(F.regexp_replace(v, expression, replacement) != quick(v)))
        checks.append(F.count_if(v.rlike(expression) != has(v)))
        hits.append(F.count_if(v.rlike(expression)))
    assert set(texts.agg(*checks).first()) == {0}
    assert min(texts.agg(*hits).first()) > 10
