"""What to do, as plain values. Limits are checked where specs come in: :mod:`.validation`."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Replace:
    """Find and replace in columns of a file, result to a Parquet folder."""

    source: str
    columns: tuple[str, ...]
    pattern: str
    replacement: str
    output: str
    file_type: str | None = None


@dataclass(frozen=True)
class Dates:
    input_formats: tuple[str, ...]
    output_format: str


@dataclass(frozen=True)
class Rules:
    """``(pattern, replacement)`` pairs, tried in order."""

    rules: tuple[tuple[str, str], ...]
