"""Multi-frame XYZ files as a Spark data source.

Files are cut in byte ranges, so one very large file is read by many tasks and
nothing scans it beforehand. A frame belongs to the range that holds its first
byte; a task finds its first frame by checking that a count line is followed by
that many atom lines and then by another count line or the end of the file.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from tiersmith.operators.rows import row_index
from tiersmith.schemas import STRUCTURES

LOOK_BACK = 1 << 16
READ_BYTES = 1 << 20
PAIR = re.compile(r'(\S+?)=("[^"]*"|\S+)|(\S+)')
COUNT = re.compile(r"\s*\d+\s*$")


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int


class _Lines:
    """Lines of an open file from an offset, with push-back, each as (offset, text)."""

    def __init__(self, handle, offset: int):
        handle.seek(offset)
        self.handle, self.at, self.tail, self.ready, self.held = handle, offset, [], iter(()), []

    def next(self):
        if self.held:
            return self.held.pop()
        line = next(self.ready, None)
        while line is None:
            more = self.handle.read(READ_BYTES)
            if not more and not self.tail:
                return None
            head, sep, rest = more.rpartition(b"\n")
            if more and not sep:  # a line longer than a block
                self.tail.append(more)
                continue
            whole = b"".join([*self.tail, head])
            self.tail = [rest] if rest else []
            if not more:
                self.tail = []
            self.ready = iter(whole.split(b"\n"))
            line = next(self.ready)
        entry = (self.at, line.decode("utf-8"))
        self.at += len(line) + 1
        return entry

    def push(self, entries):
        self.held.extend(reversed([e for e in entries if e is not None]))


def _atom(text: str):
    parts = text.split()
    try:
        return (parts[0], float(parts[1]), float(parts[2]), float(parts[3])) if parts[0][0].isalpha() else None
    except (IndexError, ValueError):
        return None


def parse_info(comment: str) -> dict[str, str]:
    return {(m[1] or m[3]): (m[2].strip('"') if m[1] else "T") for m in PAIR.finditer(comment)}


def _frame(lines: _Lines):
    """The frame at the current line and its lines, or None with the lines pushed back."""
    taken = [lines.next()]
    if taken[0] is None or not COUNT.match(taken[0][1]):
        lines.push(taken)
        return None
    n = int(taken[0][1])
    taken.append(lines.next())
    atoms = []
    for _ in range(n):
        taken.append(lines.next())
        atom = _atom(taken[-1][1]) if taken[-1] else None
        if atom is None:
            lines.push(taken)
            return None
        atoms.append(atom)
    return (taken[0][0], parse_info(taken[1][1] if taken[1] else ""), atoms), taken


def _boundary(lines: _Lines) -> bool:
    """True at the end of the file, at a blank line or before a count line."""
    entry = lines.next()
    lines.push([entry])
    return entry is None or not entry[1].strip() or bool(COUNT.match(entry[1]))


def frames_in_range(handle, start: int, end: int) -> Iterator[tuple]:
    origin = max(0, start - LOOK_BACK)
    lines = _Lines(handle, origin)
    if origin:
        lines.next()
    synced = origin == 0
    while True:
        first = lines.next()
        if first is None or first[0] >= end:
            return
        if not first[1].strip():
            continue
        lines.push([first])
        found = _frame(lines)
        if found is None or (not synced and not _boundary(lines)):
            if synced:
                raise ValueError(f"malformed frame at byte {first[0]}")
            if found is not None:
                lines.push(found[1])
            lines.next()  # go on with the line behind, from what has been read already
            continue
        synced, frame = True, found[0]
        if frame[0] >= start:
            yield frame


class XyzReader(DataSourceReader):
    def __init__(self, options: dict):
        path = options["path"]
        self.path = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        self.suffix = options.get("suffix", ".xyz")
        self.split = int(options.get("splitbytes", 64 << 20))

    def partitions(self) -> list[ByteRange]:
        fs, root = pafs.FileSystem.from_uri(self.path)
        info = fs.get_file_info(root)
        files = [info] if info.type == pafs.FileType.File else \
            [f for f in fs.get_file_info(pafs.FileSelector(root, recursive=True)) if f.path.endswith(self.suffix)]
        return [ByteRange(f.path, s, min(s + self.split, f.size)) for f in sorted(files, key=lambda f: f.path)
                for s in range(0, f.size, self.split)]

    def read(self, partition: ByteRange) -> Iterator[tuple]:
        fs, _ = pafs.FileSystem.from_uri(self.path)
        with fs.open_input_file(partition.path) as handle:
            for offset, info, atoms in frames_in_range(handle, partition.start, partition.end):
                yield partition.path, offset, info, atoms


class XyzSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "xyz"

    def schema(self) -> str:
        return STRUCTURES

    def reader(self, schema) -> DataSourceReader:
        return XyzReader(self.options)


def read_xyz(spark: SparkSession, path: str, split_bytes: int = 64 << 20, suffix: str = ".xyz") -> DataFrame:
    """Frames (file, offset, info, atoms); ``path`` is a file or a folder, absolute or a URI."""
    spark.dataSource.register(XyzSource)
    return spark.read.format("xyz").option("splitbytes", split_bytes).option("suffix", suffix).load(path)


def with_frame_numbers(structures: DataFrame) -> DataFrame:
    """Add the 0-based number of the frame within its file."""
    numbered = row_index(structures, ["offset"], group=["file"], out="frame")
    return numbered.withColumn("frame", F.col("frame") - 1)


def info_number() -> Column:
    """The first key of the info mapping as a number."""
    return F.expr("try_cast(element_at(map_keys(info), 1) as double)")
