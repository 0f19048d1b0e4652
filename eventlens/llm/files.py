"""Files in the shared folder, written and read by tasks."""
from __future__ import annotations

import uuid
from contextlib import contextmanager

from pyarrow import fs


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI or an absolute path."""
    return fs.FileSystem.from_uri(uri)


@contextmanager
def published(uri: str):
    """Write a file that appears under its name only when it is whole, so a
    retried task replaces it and a failed one leaves nothing under the name."""
    system, path = filesystem(uri)
    folder = path.rpartition("/")[0]
    system.create_dir(folder, recursive=True)
    draft = f"{folder}/.{uuid.uuid4().hex}"
    with system.open_output_stream(draft) as out:
        yield out
    system.move(draft, path)


@contextmanager
def opened(uri: str):
    system, path = filesystem(uri)
    with system.open_input_file(path) as f:
        yield f
