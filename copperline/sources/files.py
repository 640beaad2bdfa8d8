"""Opening files in tasks."""

from __future__ import annotations


def located(path: str):
    """(file system, path on it), by the path's scheme; a path without one is local."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def opened(path: str):
    """The file as a seekable source."""
    system, name = located(path)
    return system.open_input_file(name)
