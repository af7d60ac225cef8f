"""One exception type; ``code`` tells callers what went wrong."""

from __future__ import annotations

COLUMN_NOT_FOUND = "COLUMN_NOT_FOUND"
RESERVED_COLUMN = "RESERVED_COLUMN"
SOURCE_READ_ERROR = "SOURCE_READ_ERROR"
STORAGE_UNAVAILABLE = "STORAGE_UNAVAILABLE"
UNSUPPORTED_FILE_TYPE = "UNSUPPORTED_FILE_TYPE"
PREVIEW_UNAVAILABLE = "PREVIEW_UNAVAILABLE"
INVALID_PATTERN = "INVALID_PATTERN"
INVALID_SPEC = "INVALID_SPEC"


class RinseError(Exception):
    def __init__(self, code: str, message: str, names: list[str] | None = None) -> None:
        super().__init__(message)
        self.code = code
        self.names = list(names or [])


def first_line(error: BaseException) -> str:
    """The headline of a Spark error, without the JVM stack."""
    return (str(error).strip() or type(error).__name__).split("\n", 1)[0]
