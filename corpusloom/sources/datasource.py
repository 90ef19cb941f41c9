"""Files of many formats as one Spark data source: ``spark.read.format("corpusloom_files")``.

Options: ``path`` (a folder on any file system that Arrow knows) and, for each format, its patterns (``registry.PATTERNS``). Rows are lines with their format, file and
byte offset, which orders them. Partitions are byte ranges of files; filters on format, file and time of change are pushed down, so that files
which they exclude are never opened. Byte ranges begin behind the first line feed and end with the line that begins in them.
"""

from __future__ import annotations

import fnmatch
import io
from collections.abc import Iterator
from datetime import UTC, datetime

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, StringStartsWith

NAME = "corpusloom_files"
SCHEMA = "adapter string, path string, modified timestamp, file_size long, at long, line string"
#: Bytes of a range, and lines of a batch.
SPLIT_BYTES, BATCH_LINES = 64 * 1024 * 1024, 10_000
PREFIX = "pattern."


class Range(InputPartition):
    def __init__(self, adapter: str, path: str, modified: datetime | None, size: int, begin: int, end: int) -> None:
        self.adapter, self.path, self.modified, self.size, self.begin, self.end = adapter, path, modified, size, begin, end


class FilesReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.root = options["path"]
        self.split = int(options.get("splitbytes", SPLIT_BYTES))
        self.patterns = {k.removeprefix(PREFIX): v.split(",") for k, v in options.items() if k.startswith(PREFIX)}
        self.tests: list[tuple[str, str, object]] = []

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        """Keeps what decides on whole files; all else stays with Spark."""
        names = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", StringStartsWith: "starts"}
        for f in filters:
            column = getattr(f, "attribute", ())
            test = names.get(type(f))
            if test and column in (("adapter",), ("path",), ("modified",)) and (test in ("=", "in") or (test == "starts") == (column == ("path",))):
                self.tests.append((column[0], test, f.value))
            else:
                yield f

    def _passes(self, adapter: str, path: str, modified: datetime | None) -> bool:
        have = {"adapter": adapter, "path": path, "modified": modified}
        for column, test, value in self.tests:
            x = have[column]
            if x is None:
                return False
            if isinstance(value, datetime) and value.tzinfo is None:
                value = value.replace(tzinfo=UTC)
            good = {"=": lambda: x == value, "in": lambda: x in value, ">": lambda: x > value, ">=": lambda: x >= value, "<": lambda: x < value, "<=": lambda: x <= value, "starts": lambda: x.startswith(value)}[test]()
            if not good:
                return False
        return True

    def partitions(self) -> list[Range]:
        fs, root = pafs.FileSystem.from_uri(self.root) if "://" in self.root else (pafs.LocalFileSystem(), self.root)
        out = []
        for info in fs.get_file_info(pafs.FileSelector(root, recursive=True)):
            if info.type != pafs.FileType.File:
                continue
            for adapter, globs in self.patterns.items():
                if any(fnmatch.fnmatch(info.path, g) for g in globs) and self._passes(adapter, info.path, info.mtime):
                    out += [Range(adapter, info.path, info.mtime, info.size, b, min(info.size, b + self.split)) for b in range(0, info.size, self.split)]
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        fs = pafs.FileSystem.from_uri(self.root)[0] if "://" in self.root else pafs.LocalFileSystem()
        with io.BufferedReader(fs.open_input_file(partition.path), 1 << 20) as file:
            at = partition.begin
            if at:  # the line that begins before this range is its predecessor's; one that begins right here has a line feed before it
                file.seek(at - 1)
                at += len(file.readline()) - 1
            file.seek(at)
            offsets, lines = [], []
            while at < partition.end and (line := file.readline()):
                offsets.append(at)
                lines.append(line.removesuffix(b"\n").decode("utf-8", "replace"))
                at += len(line)
                if len(lines) == BATCH_LINES:
                    yield self._batch(partition, offsets, lines)
                    offsets, lines = [], []
            if lines:
                yield self._batch(partition, offsets, lines)

    @staticmethod
    def _batch(p: Range, offsets: list[int], lines: list[str]) -> pa.RecordBatch:
        n = len(lines)
        return pa.RecordBatch.from_arrays(
            [pa.array([p.adapter] * n), pa.array([p.path] * n), pa.array([p.modified] * n, pa.timestamp("us", "UTC")), pa.array([p.size] * n, pa.int64()), pa.array(offsets, pa.int64()), pa.array(lines)],
            names=[c.split()[0] for c in SCHEMA.split(", ")],
        )


class FilesSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return NAME

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FilesReader:  # noqa: ANN001, ARG002
        return FilesReader(dict(self.options))
