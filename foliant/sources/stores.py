"""Stores as Arrow opens them, for data sources whose files Spark's own readers and writers do not know."""

from __future__ import annotations

import re

from pyarrow import fs


def store(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it. Plain paths and file:/... are local, any other URI is what it says."""
    if "://" not in path:
        path = re.sub("^file:", "", path)
        if not path.startswith("/"):
            raise ValueError(f"{path!r} is neither a whole path nor a URI")
        return fs.LocalFileSystem(), path.rstrip("/") or "/"
    files, at = fs.FileSystem.from_uri(path)
    return files, at.rstrip("/") or "/"


def listed(path: str) -> list[fs.FileInfo]:
    """All files at or below a path, in the order of their paths; an error if there is nothing."""
    files, at = store(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    if info.type == fs.FileType.File:
        return [info]
    found = files.get_file_info(fs.FileSelector(at, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File), key=lambda f: f.path)
