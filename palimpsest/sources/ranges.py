"""Byte ranges of large files, as rows: a file never has to fit in one cell."""

from __future__ import annotations

import os
import stat
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition


def stable_open(path: str):
    """Open a regular file that is no link; the file opened must be the one that was seen."""
    before = os.lstat(path)
    if not stat.S_ISREG(before.st_mode):
        raise ValueError(f"{path} is not a regular file")
    f = open(path, "rb")
    after = os.fstat(f.fileno())
    if (before.st_dev, before.st_ino) != (after.st_dev, after.st_ino):
        f.close()
        raise ValueError(f"{path} changed while it was opened")
    return f


def identity(path: str) -> tuple[int, int, int]:
    """What must not change while a file is read: inode, size and modification time."""
    s = os.lstat(path)
    return s.st_ino, s.st_size, s.st_mtime_ns


class _Range(InputPartition):
    def __init__(self, path: str, offset: int, length: int, known: tuple) -> None:
        self.path, self.offset, self.length, self.known = path, offset, length, known


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], size: int) -> None:
        self.paths, self.size = paths, size

    def partitions(self) -> list[_Range]:
        out = []
        for path in self.paths:
            with stable_open(path):
                known = identity(path)
            out += [_Range(path, at, min(self.size, known[1] - at), known) for at in range(0, known[1], self.size)]
        return out

    def read(self, part: _Range) -> Iterator[tuple]:
        with stable_open(part.path) as f:
            f.seek(part.offset)
            data = f.read(part.length)
        if len(data) != part.length or identity(part.path) != part.known:
            raise ValueError(f"{part.path} changed while it was read")
        yield part.path, part.offset // self.size, part.offset, part.length, data


class ByteRanges(DataSource):
    """``spark.read.format("byteranges").option("rangeSize", n).load(paths joined by commas)``."""

    @classmethod
    def name(cls) -> str:
        return "byteranges"

    def schema(self) -> str:
        return "path string, range_idx long, offset long, length long, bytes binary"

    def reader(self, schema: object) -> _Reader:
        return _Reader(self.options["path"].split(","), int(self.options.get("rangeSize", 8 << 20)))
