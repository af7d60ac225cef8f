"""Files in folders that all executors reach, named by path or URI."""

from __future__ import annotations

import os
import uuid
from contextlib import contextmanager
from urllib.parse import unquote, urlparse


def local_path(uri: str) -> str | None:
    """The path of a plain or ``file:`` name, else None."""
    parts = urlparse(uri)
    if parts.scheme == "file":
        return unquote(parts.path)
    return None if "://" in uri else uri


def _remote(uri: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri)


@contextmanager
def written(uri: str):
    """A binary file that gets its name only when it is whole.

    An attempt that fails or runs twice leaves the name to one whole file.
    """
    path = local_path(uri)
    if path is None:
        system, path = _remote(uri)
        with system.open_output_stream(path) as out:
            yield out
        return
    os.makedirs(os.path.dirname(path), exist_ok=True)
    unfinished = f"{path}.{uuid.uuid4().hex}"
    with open(unfinished, "wb") as out:
        yield out
    os.replace(unfinished, path)


def opened(uri: str):
    """A binary file for reading."""
    path = local_path(uri)
    if path is not None:
        return open(path, "rb")
    system, path = _remote(uri)
    return system.open_input_file(path)


def names(uri: str, ending: str) -> list[str]:
    """The names below a folder that end so, in order."""
    path = local_path(uri)
    if path is not None:
        return sorted(f"{uri.rstrip('/')}/{name}" for name in os.listdir(path) if name.endswith(ending))
    from pyarrow import fs

    system, path = _remote(uri)
    found = system.get_file_info(fs.FileSelector(path))
    return sorted(f"{uri.rstrip('/')}/{info.base_name}" for info in found if info.path.endswith(ending))


def sized(uri: str, endings: tuple[str, ...]) -> list[tuple[str, int]]:
    """The files of a folder whose names end so, in order, with their sizes; of a file itself."""
    path = local_path(uri)
    if path is not None:
        if os.path.isfile(path):
            return [(uri, os.path.getsize(path))]
        found = [(name, os.path.getsize(f"{path}/{name}")) for name in os.listdir(path)]
        return sorted((f"{uri.rstrip('/')}/{name}", size) for name, size in found if name.endswith(endings))
    from pyarrow import fs

    system, path = _remote(uri)
    if system.get_file_info(path).type == fs.FileType.File:
        return [(uri, system.get_file_info(path).size)]
    found = system.get_file_info(fs.FileSelector(path))
    return sorted((f"{uri.rstrip('/')}/{info.base_name}", info.size) for info in found if info.path.endswith(endings))
