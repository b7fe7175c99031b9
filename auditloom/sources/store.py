"""Files on a mounted folder or in an object store, by path."""

from __future__ import annotations

import os
from typing import IO

import pyarrow.fs as fs


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    if path.startswith("file:"):
        return fs.LocalFileSystem(), "/" + path[5:].lstrip("/")
    if "://" in path:
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), os.path.abspath(path)


def open_file(path: str) -> IO[bytes]:
    store, inside = store_of(path)
    return store.open_input_file(inside)


def size_of(path: str) -> int:
    store, inside = store_of(path)
    return store.get_file_info(inside).size or 0


def files_under(path: str, name: str) -> list[tuple[str, int]]:
    """``path`` itself if it is a file, else all files of that name below it, sorted; each with its size."""
    store, inside = store_of(path)
    info = store.get_file_info(inside)
    if info.type == fs.FileType.File:
        return [(path, info.size or 0)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    head = path[: len(path) - len(inside)] if path.endswith(inside) else ""
    found = store.get_file_info(fs.FileSelector(inside, recursive=True))
    return sorted((head + x.path, x.size or 0) for x in found if x.type == fs.FileType.File and x.base_name == name)
