"""Names of helper columns that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def free_names(df: DataFrame, *wanted: str) -> list[str]:
    """The wanted names, each with underscores behind it until no column of ``df`` has it (in any case)."""
    taken, found = {name.lower() for name in df.columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        found.append(name)
    return found
