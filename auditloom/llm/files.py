"""Binary files that executors write to and read from the shared folder."""

from __future__ import annotations

from contextlib import contextmanager

import pyarrow.fs as fs


def _local(path: str) -> str | None:
    """The plain path of a folder that is mounted on every machine, or None for an object store."""
    if path.startswith("file:"):
        return "/" + path[5:].lstrip("/")
    return path if "://" not in path else None


def open_store(path: str) -> tuple[fs.FileSystem, str]:
    local = _local(path)
    return (fs.LocalFileSystem(), local) if local else fs.FileSystem.from_uri(path)


@contextmanager
def writing(path: str):
    """A binary stream to a new file; it counts only once its name is in a manifest."""
    store, inside = open_store(path)
    store.create_dir(inside.rpartition("/")[0], recursive=True)
    with store.open_output_stream(inside) as out:
        yield out


def mapped(path: str):
    """The file's bytes: memory-mapped where the folder is mounted, else fetched."""
    import numpy as np

    local = _local(path)
    store, inside = open_store(path)
    if store.get_file_info(inside).size == 0:
        return np.zeros(0, np.uint8)
    if local:
        return np.memmap(local, np.uint8, "r")
    with store.open_input_file(inside) as f:
        return np.frombuffer(f.read_buffer(), np.uint8)
