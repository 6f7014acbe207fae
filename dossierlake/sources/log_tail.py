"""The end of JSON-lines logs, read backwards: a Python data source with a batch and a stream reader.

``spark.read.format("log_tail").option("records", 20).load(path)`` returns the last records of each file, ``readStream`` what
is appended after the stream began.  A batch task opens one file and reads blocks from its end until it
has its records, so that what it reads depends on them, not on the length of the log.
``path`` is a local or mounted file, or a folder of them, one task a file: a log that only Spark's readers can
open is read by ``sources.tables.log_lines``.

Defined results: blank lines and a last line without its line break, which is still being written, don't
count (a batch read takes it if it is whole JSON); a line longer than ``most_bytes`` is left out, and so is what is older
(``fail_on_long`` raises instead); an empty or missing file has no records.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from ..functions.hashing import GENESIS

SCHEMA = "file string, position bigint, line string"
BLOCK = 64 * 1024
MOST_BYTES = 1 << 20


def _files(path: str) -> list[str]:
    path = path.removeprefix("file://")
    if os.path.isdir(path):
        return sorted(f"{path}/{n}" for n in os.listdir(path) if not n.startswith((".", "_")))
    return [path] if os.path.exists(path) else []


def last_lines(path: str, n: int, most_bytes: int = MOST_BYTES, fail_on_long: bool = False) -> tuple[list[tuple[int, bytes]], int]:
    """([(position, line)], bytes read): the last n lines, oldest first, from at most ``most_bytes`` of the file."""
    with open(path, "rb") as f:
        end = f.seek(0, os.SEEK_END)
        start, data = end, b""

        def whole() -> list[tuple[int, bytes]]:
            at, out = start, []
            for k, line in enumerate(data.split(b"\n")):
                # The first piece is the rest of a line that begins before, unless the file does.
                if line.strip() and (k or start == 0):
                    out.append((at, line.rstrip(b"\r")))
                at += len(line) + 1
            if out and not data.endswith(b"\n"):
                try:
                    json.loads(out[-1][1])
                except ValueError:
                    out.pop()
            return out

        found = whole()
        while start > 0 and len(found) < n and end - start < most_bytes:
            size = min(BLOCK, start, most_bytes - (end - start))
            start -= size
            f.seek(start)
            data = f.read(size) + data
            if b"\n" in data or start == 0:
                found = whole()
        if fail_on_long and start > 0 and len(found) < n:
            raise ValueError(f"{path}: fewer than {n} records in its last {most_bytes} bytes")
        return found[-n:] if n else [], end - start


class _File(InputPartition):
    def __init__(self, path: str, start: int = 0, end: int = 0):
        self.path, self.start, self.end = path, start, end


class _Tail(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.n = options["path"], int(options.get("records", 1))
        self.most, self.fail = int(options.get("most_bytes", MOST_BYTES)), str(options.get("fail_on_long", "false")).lower() == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(f) for f in _files(self.path)] or [_File("")]

    def read(self, partition: _File) -> Iterator[tuple]:
        if partition.path:
            for at, line in last_lines(partition.path, self.n, self.most, self.fail)[0]:
                yield partition.path, at, line.decode(errors="replace")


class _Follow(DataSourceStreamReader):
    """Offsets are the lengths of the files up to their last line break."""

    def __init__(self, options: dict):
        self.path, self.begin = options["path"], options.get("from", "start")

    def _ends(self) -> dict[str, int]:
        out = {}
        for path in _files(self.path):
            with open(path, "rb") as f:
                end = f.seek(0, os.SEEK_END)
                while end:
                    start = max(0, end - BLOCK)
                    f.seek(start)
                    cut = f.read(end - start).rfind(b"\n")
                    if cut >= 0:
                        end = start + cut + 1
                        break
                    end = start
                out[path] = end
        return out

    def initialOffset(self) -> dict:
        return {} if self.begin == "start" else self._ends()

    def latestOffset(self) -> dict:
        return self._ends()

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [_File(p, start.get(p, 0), at) for p, at in end.items() if at > start.get(p, 0)]

    def read(self, partition: _File) -> Iterator[tuple]:
        with open(partition.path, "rb") as f:
            f.seek(partition.start)
            at = partition.start
            while at < partition.end:
                line = f.readline()
                if line.strip():
                    yield partition.path, at, line.rstrip(b"\r\n").decode(errors="replace")
                at += len(line)


class LogTail(DataSource):
    @classmethod
    def name(cls) -> str:
        return "log_tail"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return _Tail(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _Follow(self.options)


def log_tail(spark: SparkSession, path: str, records: int, **options: object) -> DataFrame:
    """The last records of each file of a log: ``file, position, line``."""
    spark.dataSource.register(LogTail)
    return spark.read.format("log_tail").options(records=records, **options).load(path)


def log_follow(spark: SparkSession, path: str, start: str = "start") -> DataFrame:
    """What is appended to the files of a log, as a stream; ``start`` "end" leaves out what they have already."""
    spark.dataSource.register(LogTail)
    return spark.readStream.format("log_tail").option("from", start).load(path)


def log_head(spark: SparkSession, path: str) -> DataFrame:
    """``seq, hash`` of the newest record, on which the next is chained, from the end of the log alone; (0, zeros) of an empty one."""
    last = log_tail(spark, path, 1).select(F.get_json_object("line", "$.seq").cast("long").alias("seq"), F.get_json_object("line", "$.hash").alias("hash"))
    newest = last.agg(F.max_by(F.struct("seq", "hash"), "seq").alias("h"))
    return newest.select(F.coalesce("h.seq", F.lit(0)).alias("seq"), F.coalesce("h.hash", F.lit(GENESIS)).alias("hash"))
