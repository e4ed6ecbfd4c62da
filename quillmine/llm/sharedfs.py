"""Binary files in the shared folder, written and read by Python workers.

A plain path or file:// is a mounted folder: files are written in place and
read as memory maps. Other schemes go through pyarrow's file systems, and only
the ranges asked for are read.
"""

from __future__ import annotations

import os
from urllib.parse import urlparse

import numpy as np


def _local(uri: str) -> str | None:
    at = urlparse(uri)
    return at.path if at.scheme in ("", "file") else None


def open_output(uri: str):
    path = _local(uri)
    if path is None:
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        store.create_dir(inner.rsplit("/", 1)[0], recursive=True)
        return store.open_output_stream(inner)
    os.makedirs(os.path.dirname(path), exist_ok=True)
    return open(path, "wb")


class RemoteArray:
    """Slices of a file in an object store."""

    def __init__(self, uri: str, dtype: np.dtype):
        from pyarrow import fs

        store, inner = fs.FileSystem.from_uri(uri)
        self.file, self.dtype = store.open_input_file(inner), dtype

    def __getitem__(self, part: slice) -> np.ndarray:
        size = self.dtype.itemsize
        return np.frombuffer(self.file.read_at((part.stop - part.start) * size, part.start * size), dtype=self.dtype)


def open_array(uri: str, dtype: np.dtype) -> np.ndarray | RemoteArray:
    """The file as an array to take slices of; mapped where it is in a mounted folder."""
    path = _local(uri)
    if path is None:
        return RemoteArray(uri, dtype)
    if os.path.getsize(path) == 0:
        return np.empty(0, dtype=dtype)
    return np.memmap(path, dtype=dtype, mode="r")
