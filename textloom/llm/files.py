"""Binary files in shared storage, written and read inside tasks."""

from __future__ import annotations

import functools

from pyarrow import fs


def opened(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system that a URI (file:, hdfs:, s3:, gs:, abfs:) names, and the path in it."""
    return fs.FileSystem.from_uri(uri)


class Reader:
    """Reads pieces of many files; keeps the last few open."""

    def __init__(self, most: int = 16):
        self.open = functools.lru_cache(most)(self._open)

    @staticmethod
    def _open(uri: str):
        where, path = opened(uri)
        return where.open_input_file(path)

    def read(self, uri: str, offset: int, size: int) -> bytes:
        data = self.open(uri).read_at(size, offset)
        if len(data) != size:
            raise OSError(f"{uri} ends at {offset + len(data)}, expected {offset + size}")
        return data
