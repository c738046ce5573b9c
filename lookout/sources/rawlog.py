"""The raw log: gzip JSON lines by day and hour, read back although a segment was cut off."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write(records: DataFrame, path: str, time: str, mode: str = "append") -> None:
    """Rows as gzip JSON lines in folders day=.../hour=...; rows without a time lie in day=unknown."""
    day = F.coalesce(F.date_format(time, "yyyyMMdd"), F.lit("unknown"))
    hour = F.coalesce(F.date_format(time, "HH"), F.lit("00"))
    records.withColumn("day", day).withColumn("hour", hour).repartition("day", "hour").write.mode(mode).partitionBy("day", "hour").option("compression", "gzip").option("ignoreNullFields", "false").json(path)


def write_stream(records: DataFrame, path: str, checkpoint: str, time: str):
    """The same as a streaming sink with exactly-once files."""
    rows = records.withColumn("day", F.date_format(time, "yyyyMMdd")).withColumn("hour", F.date_format(time, "HH"))
    return rows.writeStream.format("json").option("compression", "gzip").option("path", path).option("checkpointLocation", checkpoint).partitionBy("day", "hour").trigger(availableNow=True).start()


def lines_of(data: bytes) -> Iterator[tuple[int, str]]:
    """Numbered complete lines of a gzip member sequence, up to where it breaks off or is corrupt; lines of any length."""
    d, rest, n, left = zlib.decompressobj(31), [], 0, memoryview(data)
    while left:
        part, left = left[:65536], left[65536:]
        while part:
            try:
                text = d.decompress(part)
            except zlib.error:
                return
            part = d.unused_data
            first, *others = text.split(b"\n")
            rest.append(first)
            for line in others:  # each ends what is held so far
                yield n, b"".join(rest).decode("utf-8", "replace")
                n, rest = n + 1, [line]
            if part:  # another gzip member follows
                d = zlib.decompressobj(31)
    if d.eof and any(rest):
        yield n, b"".join(rest).decode("utf-8", "replace")


def _portions(data: bytes, rows: int = 5_000, size: int = 8 << 20) -> Iterator[list[tuple[int, str]]]:
    """Lines in lists of at most so many, and about so many characters, so that no segment's lines are held at once."""
    held, chars = [], 0
    for n, line in lines_of(data):
        if line.strip():
            held.append((n, line))
            chars += len(line)
            if len(held) >= rows or chars >= size:
                yield held
                held, chars = [], 0
    if held:
        yield held


def read(spark: SparkSession, path: str, schema: str, since_day: str | None = None) -> DataFrame:
    """Records of all readable lines, one file (a gzip stream can't be cut) a task's work, with ``segment``, ``line`` and ``malformed``; folders of earlier days aren't opened."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.json.gz").option("recursiveFileLookup", "false").load(path)
    if since_day and "day" in files.columns:
        files = files.where((F.col("day").cast("string") >= since_day) | (F.col("day").cast("string") == "unknown"))

    def explode(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in it:
            for name, data in zip(b["path"], b["content"], strict=True):
                for rows in _portions(bytes(data)):
                    yield pd.DataFrame([(name.rsplit("/", 1)[-1], *r) for r in rows], columns=["segment", "line", "value"])

    raw = files.select("path", "content").mapInPandas(explode, "segment string, line bigint, value string")
    r = F.from_json("value", schema + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    return raw.withColumn("_r", r).withColumn("malformed", F.col("_r").isNull() | F.col("_r._bad").isNotNull()).select("segment", "line", "malformed", "_r.*").drop("_bad")
