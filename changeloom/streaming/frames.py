"""Python data source ``recorded_frames``: a recorded replication stream, followed by position.

The recording is a text file in any file system that Arrow reads (a path, or a URI such as ``file://`` or ``hdfs://``), one frame a line: number, position and payload in hex, separated by blanks, numbers rising. Offsets are frame
numbers with the byte they begin at, so a restart resumes after the last committed micro-batch and a replay reads the same frames again.
"""

from __future__ import annotations

import io
from collections.abc import Iterator

from pyarrow import fs as pafs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, SimpleDataSourceStreamReader
from pyspark.sql.types import StructType

SCHEMA = "frame_no bigint, frame_lsn string, payload binary"


def _frames(path: str, start: int, end: int | None, byte: int = 0) -> Iterator[tuple[int, str, bytes, int]]:
    """Frames from number ``start`` on, before ``end``, with where the line after each begins; reading begins at ``byte``, which must begin a line."""
    fs, name = pafs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pafs.LocalFileSystem(), path)
    with fs.open_input_file(name) as f:
        f.seek(byte)
        at = byte
        for line in io.BufferedReader(f, 1 << 20):
            at += len(line)
            no, lsn, payload = line.decode().split()
            if end is not None and int(no) >= end:
                return
            if int(no) >= start:
                yield int(no), lsn, bytes.fromhex(payload), at


class _Stream(SimpleDataSourceStreamReader):
    """Offsets hold the number of the next frame and the byte it begins at, so a micro-batch reads only its own lines."""

    def __init__(self, options: dict):
        self.path, self.most = options["path"], int(options.get("framesPerBatch", 10_000))

    def initialOffset(self) -> dict:  # noqa: N802
        return {"frame": 0, "byte": 0}

    def read(self, start: dict) -> tuple[Iterator[tuple], dict]:
        out, end = [], start
        for no, lsn, payload, at in _frames(self.path, start["frame"], None, start.get("byte", 0)):
            out.append((no, lsn, payload))
            end = {"frame": no + 1, "byte": at}
            if len(out) >= self.most:
                break
        return iter(out), end

    def readBetweenOffsets(self, start: dict, end: dict) -> Iterator[tuple]:  # noqa: N802
        return (f[:3] for f in _frames(self.path, start["frame"], end["frame"], start.get("byte", 0)))

    def commit(self, end: dict) -> None:
        """Nothing to release: the recording stays."""


class _Batch(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        return (f[:3] for f in _frames(self.path, 0, None))


class RecordedFrames(DataSource):
    @classmethod
    def name(cls) -> str:
        return "recorded_frames"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Batch(self.options)

    def simpleStreamReader(self, schema: StructType) -> SimpleDataSourceStreamReader:  # noqa: N802
        return _Stream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordedFrames)
