"""Files in the cluster's shared folder, from the driver and from tasks."""

from __future__ import annotations

from urllib.parse import urlparse

import pyarrow as pa
from pyarrow import fs


def open_fs(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; a plain path is local (the cluster mounts it everywhere)."""
    return fs.FileSystem.from_uri(uri if urlparse(uri).scheme else f"file://{uri}")


def read_range(uri: str, offset: int, length: int) -> bytes:
    system, path = open_fs(uri)
    with system.open_input_file(path) as file:
        return file.read_at(length, offset)


def mapped(uri: str) -> pa.Buffer:
    """The file's bytes: memory-mapped where the shared folder is mounted, else read."""
    system, path = open_fs(uri)
    if isinstance(system, fs.LocalFileSystem):
        with pa.memory_map(path) as file:
            return file.read_buffer() if file.size() else pa.py_buffer(b"")
    with system.open_input_file(path) as file:
        return file.read_buffer()
