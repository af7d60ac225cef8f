"""Made-up customers with mixed formats, one for each id of a table of ids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The parts customers are made of.
FIRST_NAMES = ("John", "Jane", "Alice", "Bob", "Maria", "Wei", "Priya", "Omar", "Lena", "Kofi")
LAST_NAMES = ("Doe", "Smith", "Brown", "Nguyen", "Garcia", "Chen", "Patel", "Khan", "Muller")
DOMAINS = ("example.com", "domain.com", "website.org", "mail.co.uk", "company.io")
DATE_STYLES = ("yyyy-MM-dd", "dd/MM/yyyy", "MMM d, yyyy")
PHONE_STYLES = ("+1 (%d) %d-%d", "%d-%d-%d", "%d.%d.%d")
FIRST_CUSTOMERS = (
    ("John Doe", "john.doe@example.com"),
    ("Jane Smith", "jane_smith@domain.com"),
    ("Alice Brown", "alice.brown@website.org"),
)


def customers(ids: DataFrame, column: str = "id", seed: int = 42) -> DataFrame:
    """``ID, Name, Email, Phone, SignupDate, Notes``, all strings.

    Every value depends on the seed and the id alone, so the table is the same however it is
    partitioned, and as large as the table of ids.
    """
    number = F.col(column).cast("long")

    def draw(what: str, low: int, high: int) -> Column:
        spread = F.pmod(F.xxhash64(F.lit(seed), number, F.lit(what)), F.lit(high - low + 1))
        return (spread + low).cast("int")

    def pick(what: str, options: Sequence[Column]) -> Column:
        return F.element_at(F.array(*options), draw(what, 1, len(options)))

    def fixed(field: int, otherwise: Column) -> Column:
        rows = F.array(*(F.lit(row[field]) for row in FIRST_CUSTOMERS))
        first = number.between(1, len(FIRST_CUSTOMERS))
        return F.when(first, F.get(rows, (number - 1).cast("int"))).otherwise(otherwise)

    first_name = pick("first", [*map(F.lit, FIRST_NAMES)])
    last_name = pick("last", [*map(F.lit, LAST_NAMES)])
    domain = pick("domain", [*map(F.lit, DOMAINS)])
    address = F.lower(F.concat(first_name, F.lit("."), last_name, number, F.lit("@"), domain))
    day = F.make_date(draw("year", 2018, 2025), draw("month", 1, 12), draw("day", 1, 28))
    digits = draw("area", 200, 999), draw("middle", 200, 999), draw("line", 1000, 9999)

    people = ids.select(
        number.cast("string").alias("ID"),
        fixed(0, F.concat_ws(" ", first_name, last_name)).alias("Name"),
        fixed(1, address).alias("Email"),
        pick("phone", [F.format_string(style, *digits) for style in PHONE_STYLES]).alias("Phone"),
        pick("date", [F.date_format(day, style) for style in DATE_STYLES]).alias("SignupDate"),
        draw("notes", 1, 5).alias("__note"),
    )
    notes = F.array(
        F.lit(""),
        F.lit("VIP customer"),
        F.concat(F.lit("Contact backup at "), "Email"),
        F.lit("Prefers phone"),
        F.concat(F.lit("Call "), "Phone"),
    )
    return people.withColumn("Notes", F.element_at(notes, F.col("__note"))).drop("__note")
