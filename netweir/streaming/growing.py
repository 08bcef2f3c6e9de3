"""Lines of files that grow: a streaming source whose offsets are bytes of each file.

A file's offset is its size when it was listed. Of the bytes between two offsets a batch takes the lines
that end there: a line is read when its line end has arrived, from where it began, however many batches ago,
and a half-written one is left for later. So what a batch holds follows from its offsets alone. They are kept
in the query's checkpoint, and a query that starts again reads on where it was. Long stretches are read in
pieces by several tasks, cut by the same rule.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from netweir.sources.flows import parse_capture

SCHEMA = "file string, at long, line string"
CHUNK = 1 << 20


class Piece(InputPartition):
    def __init__(self, file: str, start: int, end: int):
        self.file, self.start, self.end = file, start, end


def line_start(source, at: int) -> int:
    """Where the line that holds byte `at` begins: after the last line end before it."""
    while at > 0:
        low = max(0, at - CHUNK)
        source.seek(low)
        found = source.read(at - low).rfind(b"\n")
        if found >= 0:
            return low + found + 1
        at = low
    return 0


def ended_lines(source, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """(place, line) of the lines whose line end lies in [start, end)."""
    at = begin = line_start(source, start)
    source.seek(at)
    held: list[bytes] = []
    while at < end:
        data = source.read(min(CHUNK, end - at))
        if not data:
            return
        *whole, rest = data.split(b"\n")
        for part in whole:
            held.append(part)
            line = b"".join(held)
            yield begin, line
            begin += len(line) + 1
            held = []
        held.append(rest)
        at += len(data)


class GrowingReader(DataSourceStreamReader):
    def __init__(self, options: dict):
        self.path, self.suffix = options["path"], options.get("suffix", "")
        self.piece = int(options.get("pieceBytes", 64 << 20))
        self.encoding = options.get("encoding", "utf-8")

    def _sizes(self) -> dict[str, int]:
        system, path = fs.FileSystem.from_uri(self.path)
        found = system.get_file_info(fs.FileSelector(path, allow_not_found=True, recursive=True))
        return {i.path: i.size for i in found if i.type == fs.FileType.File and i.path.endswith(self.suffix)
                and not i.base_name.startswith((".", "_"))}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return self._sizes()

    def partitions(self, start: dict, end: dict) -> list[Piece]:
        """Pieces of what came after `start`. A file that has shrunk gives nothing until it is longer again."""
        out = []
        for file, size in sorted(end.items()):
            for low in range(start.get(file, 0), size, self.piece):
                out.append(Piece(file, low, min(low + self.piece, size)))
        return out

    def read(self, partition: Piece) -> Iterator[pa.RecordBatch]:
        system, _ = fs.FileSystem.from_uri(self.path)
        names = ["file", "at", "line"]
        with system.open_input_file(partition.file) as source:
            rows, size = [], 0

            def batch():
                places, lines = zip(*rows)
                texts = [x.decode(self.encoding, "replace").rstrip("\r") for x in lines]
                return pa.RecordBatch.from_arrays([pa.array([partition.file] * len(rows)), pa.array(places, pa.int64()), pa.array(texts)], names)

            for at, line in ended_lines(source, partition.start, partition.end):
                rows.append((at, line))
                size += len(line)
                if size > CHUNK or len(rows) >= 10_000:
                    yield batch()
                    rows, size = [], 0
            if rows:
                yield batch()


class GrowingLines(DataSource):
    """Options: path (a folder that grows, any file system that Arrow reads), suffix, encoding, pieceBytes."""

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema) -> DataSourceStreamReader:
        return GrowingReader(dict(self.options))


def growing_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """(file, at, line) of the files below a folder, each line once when its end has been written."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").options(**options).load(path)


def follow_capture(lines: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(records, malformed lines) of a stream of CSV lines whose files have a header, with file and place.

    Blank lines and headers are left out; a line with another number of values than columns is malformed.
    """
    return parse_capture(lines, "line", columns, ["file", "at"])
