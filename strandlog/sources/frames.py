"""Length-prefixed frames as a data source, for batches and streams.

``spark.read.format("frames").load(folder)`` gives (file, number, body) of every frame of every file. A frame is its
body's length as 32 bits, little-endian, and the body; with option ``checked`` the body's CRC-32 stands between them, and
reading a file ends at its first torn frame, as after a crash. Without it a frame that can't be right raises. Files are
read a piece at a time, so a file may have any size; each is a task."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

MAX_BODY = 16 << 20
PIECE = 1 << 20


class FrameError(ValueError):
    """The stream can't be trusted from here on."""


class FrameStream:
    """Reassembles frames from pieces of any size."""

    def __init__(self, checked: bool = False, most: int = MAX_BODY):
        self.buffer, self.checked, self.most, self.torn = bytearray(), checked, most, False

    def feed(self, data: bytes) -> Iterator[bytes]:
        self.buffer += data
        at, head = 0, 8 if self.checked else 4
        while not self.torn and len(self.buffer) - at >= head:
            size = int.from_bytes(self.buffer[at : at + 4], "little")
            if size > self.most:
                if not self.checked:
                    raise FrameError(f"a frame of {size} bytes")
                self.torn = True
            if self.torn or len(self.buffer) - at < head + size:
                break
            body = bytes(self.buffer[at + head : at + head + size])
            if self.checked and zlib.crc32(body) != int.from_bytes(self.buffer[at + 4 : at + 8], "little"):
                self.torn = True
                break
            at += head + size
            yield body
        del self.buffer[:at]


def frame(body: bytes, checked: bool = False) -> bytes:
    crc = zlib.crc32(body).to_bytes(4, "little") if checked else b""
    return len(body).to_bytes(4, "little") + crc + body


def write(rows: DataFrame, folder: str, by: str, order: str) -> None:
    """Write each peer's bodies (columns ``by``, ``order``, ``body``) in order as checked frames to a file of its own. Rows with
    ``torn`` set get a checksum that is wrong, as after a crash. A file's name has the peer and its first attempt; one that a
    lost task left behind is overwritten."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, peer, n = None, None, 0
        files, base = pafs.FileSystem.from_uri(folder) if "://" in folder else (pafs.LocalFileSystem(), folder.removeprefix("file:"))
        files.create_dir(base, recursive=True)
        try:
            for batch in batches:
                for own, body, torn in zip(*(batch.column(c).to_pylist() for c in (by, "body", "torn")), strict=True):
                    if out is None or own != peer:
                        if out is not None:
                            out.close()
                        out, peer = files.open_output_stream(f"{base}/peer-{own}.frames", compression=None), own
                    data = frame(body, True)
                    out.write(data[:4] + bytes(b ^ 255 for b in data[4:8]) + data[8:] if torn else data)
                    n += 1
        finally:
            if out is not None:
                out.close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], names=["n"])

    torn = F.col("torn") if "torn" in rows.columns else F.lit(False)
    dealt = rows.select(by, order, "body", torn.alias("torn")).repartition(by).sortWithinPartitions(by, order)
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()


def _files(uri: str) -> tuple[pafs.FileSystem, list[str]]:
    files, base = pafs.FileSystem.from_uri(uri) if "://" in uri else (pafs.LocalFileSystem(), uri)
    info = files.get_file_info(base)
    if info.type == pafs.FileType.File:
        return files, [base]
    return files, sorted(x.path for x in files.get_file_info(pafs.FileSelector(base)) if x.type == pafs.FileType.File)


class _File(InputPartition):
    def __init__(self, path: str):
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.uri, self.checked = options["path"], str(options.get("checked", "false")).lower() == "true"

    def partitions(self) -> list[_File]:
        return [_File(p) for p in _files(self.uri)[1]]

    def read(self, part: _File) -> Iterator[tuple]:
        files, _ = _files(self.uri)
        stream, number = FrameStream(self.checked), 0
        with files.open_input_stream(part.path) as f:
            while piece := f.read(PIECE):
                for body in stream.feed(piece):
                    yield part.path.rsplit("/", 1)[-1], number, body
                    number += 1


class _StreamReader(DataSourceStreamReader):
    """Each file is read once, by a task of its own; files arrive whole, under names that sort in order of arrival. Only
    names reach the driver."""

    def __init__(self, options: dict):
        self.reader = _Reader(options)

    def _name(self, part: _File) -> str:
        return part.path.rsplit("/", 1)[-1]

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        return {"after": max(map(self._name, self.reader.partitions()), default="")}

    def partitions(self, start: dict, end: dict) -> list[_File]:
        return [p for p in self.reader.partitions() if start["after"] < self._name(p) <= end["after"]]

    def read(self, part: _File) -> Iterator[tuple]:
        return self.reader.read(part)

    def commit(self, end: dict) -> None:
        pass


class FrameSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "frames"

    def schema(self) -> str:
        return "file string, number long, body binary"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def streamReader(self, schema) -> DataSourceStreamReader:
        return _StreamReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FrameSource)
