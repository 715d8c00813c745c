"""Files of our own formats in shared storage, written by tasks that may run twice."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Iterator

import pyarrow.fs as pafs


def place(uri: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(uri)


@contextlib.contextmanager
def created(uri: str) -> Iterator:
    """A stream whose file takes its name only when it is whole: a second attempt at a task replaces the same file by the same bytes."""
    fs, path = place(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    own = f"{path}.{uuid.uuid4().hex}.part"
    try:
        with fs.open_output_stream(own) as out:
            yield out
        fs.move(own, path)
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(own)
        raise


def opened(uri: str):
    fs, path = place(uri)
    return fs.open_input_file(path)
