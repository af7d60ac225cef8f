"""Memory of Python workers, which live on from one task to the next."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator
from functools import wraps

import pyarrow as pa


def give_back() -> None:
    """Return what Arrow and the C library keep of freed memory to the system."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def giving_back(function: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches, after each of which, and at its end, memory is given back."""

    @wraps(function)
    def run(batches):
        def seen():
            for batch in batches:
                yield batch
                del batch
                give_back()

        try:
            yield from function(seen())
        finally:
            give_back()

    return run
