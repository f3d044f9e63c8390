"""Files in the folder that the driver and all executors share, opened by URI (file, hdfs, s3, gs)."""

from __future__ import annotations

import uuid
from contextlib import contextmanager


def _open(uri: str):
    from pyarrow import fs

    if uri.startswith("file:") and not uri.startswith("file://"):
        uri = "file://" + uri[5:]
    return fs.FileSystem.from_uri(uri) if "://" in uri else (fs.LocalFileSystem(), uri)


@contextmanager
def new_file(folder: str, stem: str, suffix: str):
    """Open a new file for writing; gives (file, its URI). Every attempt of a task has a name of its own, and
    only the names that successful attempts return are ever read."""
    uri = f"{folder.rstrip('/')}/{stem}-{uuid.uuid4().hex[:12]}{suffix}"
    system, path = _open(uri)
    system.create_dir(path.rsplit("/", 1)[0], recursive=True)
    with system.open_output_stream(path, compression=None) as out:
        yield out, uri


def read_stream(uri: str):
    system, path = _open(uri)
    return system.open_input_stream(path, compression=None)


def read_random(uri: str):
    system, path = _open(uri)
    return system.open_input_file(path)
