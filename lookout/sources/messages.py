"""A Python data source of recorded certificate messages: JSON lines, batch and streaming, with reconnects counted.

A live websocket would need a client library and network, so it stays a producer outside Spark that appends to the file.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "line bigint, value string"


class MessageSource(DataSource):
    """spark.read/readStream.format("certmessages").option("path", file); ``splits``: of a batch read; ``bytes``: of a split of a
    micro-batch. The file must lie where all executors can open it.
    """

    @classmethod
    def name(cls) -> str:
        return "certmessages"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Whole(self.options["path"], int(self.options.get("splits", 8)))

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Tail(self.options["path"], int(self.options.get("bytes", 64 << 20)))


class _Range(InputPartition):
    def __init__(self, start: int, end: int):
        self.start, self.end = start, end


class _Whole(DataSourceReader):
    """Byte ranges of the file; a line belongs to the range in which it begins. ``line`` is its byte offset."""

    def __init__(self, path: str, splits: int):
        self.path, self.splits = path, splits

    def partitions(self):
        size = os.path.getsize(self.path)
        step = max(1, -(-size // self.splits))
        return [_Range(i, min(size, i + step)) for i in range(0, size, step)] or [_Range(0, 0)]

    def read(self, partition) -> Iterator[tuple]:
        with open(self.path, "rb") as f:
            if partition.start:
                f.seek(partition.start - 1)
                f.readline()
            while (at := f.tell()) < partition.end:
                line = f.readline()
                if not line:
                    break
                yield at, line.rstrip(b"\r\n").decode("utf-8", "replace")


class _Tail(DataSourceStreamReader):
    """Whole lines from the byte offset on, in byte ranges that executors read; an unfinished last line waits.

    The driver only looks for the file's last line end.
    """

    def __init__(self, path: str, most: int):
        self.path, self.most = path, most
        self.whole = _Whole(path, 1)

    def initialOffset(self) -> dict:
        return {"at": 0}

    def latestOffset(self) -> dict:
        with open(self.path, "rb") as f:
            at = f.seek(0, os.SEEK_END)
            while at > 0:
                start = max(0, at - 65536)
                f.seek(start)
                found = f.read(at - start).rfind(b"\n")
                if found >= 0:
                    return {"at": start + found + 1}
                at = start
        return {"at": 0}

    def partitions(self, start: dict, end: dict):
        return [_Range(i, min(end["at"], i + self.most)) for i in range(start["at"], end["at"], self.most)]

    def read(self, partition) -> Iterator[tuple]:
        return self.whole.read(partition)

    def commit(self, end: dict) -> None:
        pass
