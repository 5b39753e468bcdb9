"""Files in the shared folder, read and written by Python on the executors through pyarrow's file systems."""

from __future__ import annotations

import uuid

from pyarrow import fs


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system and the path in it; any scheme that pyarrow knows, or a plain local path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def attempt(folder: str, name: str, suffix: str) -> str:
    """A path that no other attempt of the same task writes: the rows of the attempt that Spark accepts name the files
    that count, those of lost attempts stay unread."""
    system, inside = opened(folder)
    system.create_dir(inside, recursive=True)
    return f"{folder}/{name}-{uuid.uuid4().hex}{suffix}"
