"""Files that tasks write to and read from the folder that driver and executors share.

A task names its files anew on every attempt and returns the names as rows; the table of these rows says
which files count, so files of failed or repeated attempts are never read.
"""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyarrow import fs


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    """The store and the path in it; a path without a scheme is on the machine itself."""
    return fs.FileSystem.from_uri(uri) if ":" in uri.split("/", 1)[0] else (fs.LocalFileSystem(), uri)


def put(folder: str, name: str, data: bytes | pa.Buffer) -> str:
    """Stores data in a folder under a name of its own, which is returned."""
    store, path = _at(folder)
    store.create_dir(path, recursive=True)
    name = f"{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(f"{path}/{name}") as out:
        out.write(data)
    return f"{folder}/{name}"


def opened(uri: str) -> pa.NativeFile:
    """A file to read from at any offset."""
    store, path = _at(uri)
    return store.open_input_file(path)
