"""A streaming source of text lines that reads on in files that grow, as logs do."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

#: Bytes that are looked at together: of a tail that is searched for a line's end, and of a range that is read.
TAIL, STEP = 1 << 16, 1 << 20


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a URI, or of a path on a local disk."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _files(path: str) -> dict[str, int]:
    """Sizes of the file at ``path`` or of all files below it, hidden ones left out. None yet is no error: a log may begin later."""
    system, root = _opened(path)
    info = system.get_file_info(root)
    found = [info] if info.is_file else system.get_file_info(fs.FileSelector(root, recursive=True, allow_not_found=True))
    return {i.path: i.size for i in found if i.is_file and not i.base_name.startswith((".", "_"))}


def last_line_end(system: fs.FileSystem, path: str, size: int) -> int:
    """The place after the last line break among the first ``size`` bytes; 0 if there is none."""
    with system.open_input_file(path) as file:
        end = size
        while end > 0:
            begin = max(0, end - TAIL)
            place = file.read_at(end - begin, begin).rfind(b"\n")
            if place >= 0:
                return begin + place + 1
            end = begin
    return 0


@dataclass
class Range(InputPartition):
    """Bytes of a file. Whoever holds a line's first byte reads the line."""

    path: str
    begin: int
    end: int
    first: bool


def lines_of(system: fs.FileSystem, part: Range) -> Iterator[tuple[list[int], list[bytes]]]:
    """(places, lines) of a range, about STEP bytes at a time. A range that isn't the first starts after its first line break, and runs on to its last line's end."""
    with system.open_input_file(part.path) as file:
        size = file.size()
        at = part.begin - (0 if part.first else 1)
        held, skipping = b"", not part.first
        while at < size:
            piece = file.read_at(min(STEP, size - at), at)
            if not piece:
                return
            start, held = at - len(held), held + piece
            at += len(piece)
            *whole, held = held.split(b"\n")
            places, lines = [], []
            for line in whole:
                if skipping:
                    skipping = False
                elif start >= part.end:
                    break
                else:
                    places.append(start)
                    lines.append(line)
                start += len(line) + 1
            yield places, lines
            if not skipping and start >= part.end:
                return


class _Reader(DataSourceStreamReader):
    """An offset is {file: bytes read}, each after a line's end, so that half a line waits for its other half."""

    def __init__(self, options: dict):
        self.path, self.step = options["path"], int(options.get("bytesPerTask", 64 << 20))
        self.known: dict[str, tuple[int, int]] = {}

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        system, _ = _opened(self.path)
        for file, size in _files(self.path).items():
            if self.known.get(file, (-1, 0))[0] != size:
                self.known[file] = (size, last_line_end(system, file, size))
        return {file: end for file, (_, end) in sorted(self.known.items()) if end}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        out = []
        for file, to in end.items():
            begin = start.get(file, 0)
            begin = 0 if begin > to else begin  # shorter than what was read: the file was begun anew
            cuts = [*range(begin, to, self.step), to]
            out += [Range(file, a, b, a == begin) for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        system, _ = _opened(self.path)
        for places, lines in lines_of(system, partition):
            if lines:
                texts = pa.array([line.removesuffix(b"\r").decode("utf-8", "replace") for line in lines], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([partition.path] * len(lines)), pa.array(places, pa.int64()), texts], names=["file", "place", "line"])

    def commit(self, end: dict) -> None:
        pass


class GrowingLines(DataSource):
    """(file, place, line): each whole line of the files under ``path`` once, whenever it is added.

    The place is the line's first byte. A file that was appended to is read on from where the last micro-batch ended; a
    line without its end waits. Large additions are split into ranges of ``bytesPerTask`` bytes. The places read are the
    stream's offsets, so that a restarted stream goes on from its checkpoint. A file that has become shorter counts as new.
    """

    @classmethod
    def name(cls) -> str:
        return "growing_lines"

    def schema(self) -> str:
        return "file string, place long, line string"

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options)


def growing_lines(spark: SparkSession, path: str, bytes_per_task: int = 64 << 20) -> DataFrame:
    """A stream (file, place, line) of the lines under ``path``, a folder or one file, that grows with its files."""
    spark.dataSource.register(GrowingLines)
    return spark.readStream.format("growing_lines").option("path", path).option("bytesPerTask", str(bytes_per_task)).load()


def parsed_lines(lines: DataFrame, schema: str) -> DataFrame:
    """The columns of JSON lines, as read_log() has them: blank and malformed lines are passed over."""
    held = lines.where("trim(line) <> ''").select(F.from_json("line", f"{schema}, _malformed string", {"columnNameOfCorruptRecord": "_malformed"}).alias("j"))
    return held.where("j is not null and j._malformed is null").select("j.*").drop("_malformed")
